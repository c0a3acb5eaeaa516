"""Rows expected of queries over literal fixtures that SQL can't express, written out and checked against the definitions by hand."""

from __future__ import annotations

from codexa.plans.fixtures import Fixture

ROWS: dict[str, Fixture] = {
    "honorifics": Fixture(
        "id int, cleaned string, abbreviations string, shown string, said string, leads boolean, lead_kind string, rest string, spoken string, doubled boolean, fixed string",
        [
            (1, 'قال رسول الله إنما الأعمال بالنيات', 'SAW', 'قال رسول الله ﷺ إنما الأعمال بالنيات', 'قال رسول الله صَلَّى اللهُ عَلَيْهِ وَسَلَّمَ إنما الأعمال بالنيات', False, None, 'قال رسول الله ﷺ إنما الأعمال بالنيات', 'قال رسول الله ﷺ إنما الأعمال بالنيات', False, 'قال رسول الله ﷺ إنما الأعمال بالنيات'),
            (2, 'بِسْمِ اللَّهِ الرَّحْمَٰنِ', '', 'بِسْمِ اللَّهِ الرَّحْمَٰنِ', 'بِسْمِ اللَّهِ الرَّحْمَٰنِ', False, None, 'بِسْمِ اللَّهِ الرَّحْمَٰنِ', 'بِسْمِ اللَّهِ الرَّحْمَٰنِ', False, 'بِسْمِ اللَّهِ الرَّحْمَٰنِ'),
            (3, 'Shaykh al-Qushayri wrote 12 chapters', '', 'Shaykh al-Qushayri wrote 12 chapters', 'Shaykh al-Qushayri wrote 12 chapters', False, None, 'Shaykh al-Qushayri wrote 12 chapters', 'Shaykh al-Qushayri wrote 12 chapters', False, 'Shaykh al-Qushayri wrote 12 chapters'),
            (4, 'ْword َanother', '', 'ْword َanother', 'ْword َanother', False, None, 'ْword َanother', 'ْword َanother', False, 'ْword َanother'),
            (5, 'a b c', 'SAW,SWT', 'aﷺb ﷻ c', 'aصَلَّى اللهُ عَلَيْهِ وَسَلَّمَb سُبْحَانَهُ وَتَعَالَى c', False, None, 'a\uf067b ﷻ c', 'a\uf067b ﷻ c', False, 'a\uf067b ﷻ c'),
            (6, '', '', '', '', False, None, '', '', False, ''),
            (7, 'plain ASCII text , with . spaces !', '', 'plain ASCII text , with . spaces !', 'plain ASCII text , with . spaces !', False, None, 'plain ASCII text , with . spaces !', 'plain ASCII text , with . spaces !', False, 'plain ASCII text , with . spaces !'),
            (8, 'twice (pbuh)', 'SAW', 'ﷺ ﷺ twice (pbuh) ﷺ', 'صَلَّى اللهُ عَلَيْهِ وَسَلَّمَ صَلَّى اللهُ عَلَيْهِ وَسَلَّمَ twice (صَلَّى اللهُ عَلَيْهِ وَسَلَّمَ) صَلَّى اللهُ عَلَيْهِ وَسَلَّمَ', True, 'SAW', 'ﷺ twice (pbuh) ﷺ', 'ﷺ twice (pbuh) ﷺ صلى الله عليه وسلم', True, 'ﷺ twice ﷺ'),
            (9, '\ue001\ue002', '', '\ue001\ue002', '\ue001\ue002', False, None, '\ue001\ue002', '\ue001\ue002', False, '\ue001\ue002'),
            (10, 'مدرسة الحكمة أحمد إلى', '', 'مدرسة الحكمة أحمد إلى', 'مدرسة الحكمة أحمد إلى', False, None, 'مدرسة الحكمة أحمد إلى', 'مدرسة الحكمة أحمد إلى', False, 'مدرسة الحكمة أحمد إلى'),
            (11, 'o|ce di|erent e|ect |table| Shā\x7fʿīs', '', 'o|ce di|erent e|ect |table| Shā\x7fʿīs', 'o|ce di|erent e|ect |table| Shā\x7fʿīs', False, None, 'o|ce di|erent e|ect |table| Shā\x7fʿīs', 'o|ce di|erent e|ect |table| Shā\x7fʿīs', False, 'o|ce di|erent e|ect |table| Shā\x7fʿīs'),
            (12, '٣٤٥ and 17 and 17', '', '٣٤٥ and 17 and 17', '٣٤٥ and 17 and 17', False, None, '٣٤٥ and 17 and 17', '٣٤٥ and 17 and 17', False, '٣٤٥ and 17 and 17'),
        ],
    ),
    "skeletons": Fixture(
        "id int, ar_h string, ar_t string, latin string, variants string",
        [
            (1, 'klrslhnmlmlblnt', 'klrslhnmlmlblnt', 'thmsngrsdctnsrbntntns', 'thmsngrsdctnsrbntntns,tmsngrsdctnsrbntntns'),
            (2, 'bsmlhlrhmn', 'bsmlhlrhmn', 'nthnmfgd', 'nthnmfgd,ntnmfgd'),
            (3, '', '', '', ''),
            (4, '', '', 'mxd', 'mxd'),
            (5, '', '', 'pbhsx', 'pbhsx'),
            (6, '', '', 'mpt', 'mpt'),
            (7, '', '', 'pln', 'pln'),
            (8, '', '', 's', 's'),
            (9, '', '', 'glphs', 'glphs'),
            (10, 'mdrshlhkmhmdl', 'mdrstlhkmthmdl', 'mdrstlhkm', 'mdrstlhkm'),
            (11, '', '', 'mrks', 'mrks'),
            (12, '', '', '', ''),
        ],
    ),
    "edit_similarity": Fixture(
        "id int, normal string, similarity double",
        [
            (1, 'abc', 1.0),
            (2, 'kitten', 0.571429),
            (3, 'alqushayrī', 1.0),
            (4, '', 0.0),
            (5, '', 0.0),
            (6, 'مدرسه', 1.0),
            (7, 'احمد', 1.0),
            (8, 'fine', 1.0),
            (9, 'abcd', 0.0),
            (10, 'ab', 1.0),
        ],
    ),
    "bidi_text": Fixture(
        "id int, protected string, semantic string, visual string, heading string",
        [
            (1, 'ربيعة \u2066(2)\u2069 بن حارثة', 'ربيعة (2) بن حارثة', 'ةثراح نب )2( ةعيبر', 'ربيعة (2) بن حارثة'),
            (2, 'ربيعة \u2066(2)\u2069 بن حارثةـ', 'ربيعة (2) بن حارثة', 'ةثراح نب )2( ةعيبر', 'ربيعة \u2066(2)\u2069 بن حارثةـ'),
            (3, 'عَلِيّ', 'عَلِيّ', 'يّلِعَ', 'عَلِيّ'),
            (4, '\u2066Ibn\u2069 \u2066Khallikan\u2069', 'Ibn Khallikan', 'Ibn Khallikan', 'Ibn Khallikan'),
            (5, '\u206612\u2069 - إبراهيم النخعي', '12 - إبراهيم النخعي', 'يعخنلا ميهاربإ - 21', '١٢ - إبراهيم النخعي'),
            (6, '\u20667-\u2069 \u2066a\u2069 \u20668\u2069 - \u2066b\u2069', '7- a 8 - b', '7- a 8 - b', '٧- a 8 - b'),
            (7, '', '', '', ''),
            (8, '\u2066page\u2069 \u20663:\u2069 \u2066a/b_c\u2069 \u2066(x)\u2069', 'page 3: a/b_c (x)', 'page 3: a/b_c (x)', 'page 3: a/b_c (x)'),
        ],
    ),
    "name_skeletons": Fixture(
        "id int, names string, anchors string",
        [
            (1, 'smth', ''),
            (2, 'qshr,bghd,thqf,slm,ghzl', 'qshr,bghd,thqf,ghzl'),
            (3, '', ''),
            (4, 'slnd,khld,dhb,thn', 'khld,dhb'),
            (8, '', ''),
        ],
    ),
    "pair_evidence": Fixture(
        "id int, names string, numbers string, mass int, score double",
        [
            (1, '', '1', 6, 0.233333),
            (2, 'qshr', '437', 10, 0.54),
            (3, '', '', 0, 0.127778),
            (4, '', '', 0, -2.4),
            (5, '', '', 0, 0.127778),
        ],
    ),
    "sentence_lists": Fixture(
        "id int, sentences string",
        [
            (1, 'He met Mr. Smith.|"Yes," he said. then left.|See i.e. this!|"Quote."|End'),
            (2, 'Dr. Ali ibn al-Qushayri came to Baghdad.|Thaqif fought.|ISLAM spread; Ghazali wrote.'),
            (3, 'No stop here'),
            (4, "The Island contained trees.|Abu Khalid and Da'ud saw Qadi-Dhahabi?!|Then 'Abd Allah left"),
            (5, 'قال كذا.|ثم خرج؟|نعم!|انتهى'),
            (6, 'كلمة كلمة كلمة كلمة كلمة كلمة كلمة كلمة كلمة كلمة كلمة كلمة كلمة كلمة كلمة كلمة كلمة كلمة كلمة كلمة كلمة كلمة كلمة كلمة كلمة كلمة كلمة كلمة كلمة كلمة،|لفظ لفظ لفظ لفظ لفظ لفظ لفظ لفظ لفظ لفظ لفظ لفظ لفظ لفظ لفظ لفظ لفظ لفظ لفظ لفظ لفظ لفظ لفظ لفظ لفظ لفظ لفظ لفظ لفظ لفظ؛ ذيل قصير.'),
            (7, ''),
            (8, ''),
        ],
    ),
    "page_lines": Fixture(
        "id int, counts string",
        [
            (1, '3,2'),
            (2, '0,4'),
            (3, '39,2'),
            (4, '0,40,4'),
            (5, '26,6'),
            (6, ''),
            (7, '7'),
            (8, '9'),
            (9, '0,5'),
            (10, '30,40,20'),
        ],
    ),
    "elongations": Fixture(
        "id int, places string, filled string",
        [
            (1, '1,2', 'بــيـت'),
            (2, '1', 'ســــلام'),
            (3, '2,4,6,7,8,9', 'عَــلِـيّ كـتـب'),
            (4, '', 'دار'),
            (5, '', 'Latin word'),
            (6, '1,2,3,4,5,6,7,8,9', 'مكتبة كبيرة'),
            (7, '1', 'نــــــــــص'),
        ],
    ),
    "glyph_regions": Fixture(
        "page int, span_no int, x0 double, y1 double, font string, text string, size double, mushaf_page int",
        [
            (1, 0, 1.0, 14.0, 'QCF_P002', 'ﱁﱂ', 12.5, 2),
            (2, 1, 0.0, 0.0, 'kfgqpc_P12', 'x ﱁ', 8.0, 12),
        ],
    ),
    "font_spans": Fixture(
        "page int, span_no int, x0 double, y0 double, x1 double, y1 double, font string",
        [
            (2, 0, 5.0, 6.0, 7.0, 8.0, 'SabondiexPlain'),
        ],
    ),
    "real_boxes": Fixture(
        "page int, word_no int",
        [
            (-1, 2),
            (1, 0),
            (1, 2),
            (1, 3),
            (2, 0),
            (2, 1),
            (2, 2),
            (3, 0),
        ],
    ),
    "loose_words": Fixture(
        "text string, spoken_text string, language string, role string, section_type string, block_no long, x double, y double, page int, is_word_continuation boolean",
        [
            ('', '', 'en', 'body', 'body', 0, None, None, None, False),
            ('a', 'a', 'en', 'body', 'body', 0, 1.0, 2.0, None, False),
            ('b', 'bee', 'en', 'quran', 'body', 7, 3.0, 4.0, 9, True),
        ],
    ),
    "markdown_blocks": Fixture(
        "id int, block_seq int, type string, text string",
        [
            (1, 1, 'heading', 'Title here'),
            (1, 2, 'paragraph', 'line one line two'),
            (1, 3, 'verse', 'قال النبي'),
            (1, 4, 'paragraph', 'English quote'),
            (1, 5, 'paragraph', 'after'),
            (2, 1, 'paragraph', 'text more label and co*de'),
            (3, 1, 'heading', 'deep'),
            (3, 2, 'paragraph', '- item a'),
            (3, 3, 'paragraph', 'quoted'),
            (5, 1, 'paragraph', 'spans lines [a] (b)'),
        ],
    ),
    "html_fragments": Fixture(
        "id int, text string",
        [
            (1, 'One two three & four .'),
            (2, 'a b c var x = 1;d'),
            (3, '<tag> x'),
            (4, 'x y zw'),
            (5, ''),
            (6, 'plain , text'),
        ],
    ),
    "figures_placed": Fixture(
        "doc_id long, block_seq int, page int, type string, text string, figure_type string, caption string",
        [
            (1, 1, 0, 'figure', 'Same. Same', 'table', 'Same'),
            (1, 2, 1, 'paragraph', 'first', None, None),
            (1, 3, 1, 'figure', 'A caption. More', 'chart', 'A caption'),
            (1, 4, 1, 'figure', 'Only described', 'photo', None),
            (1, 5, 1, 'paragraph', 'second', None, None),
            (1, 6, 2, 'heading', 'third', None, None),
            (2, 1, 3, 'figure', '', 'map', ''),
        ],
    ),
    "figures_rendered": Fixture(
        "doc_id long, fig int, markdown string, plain string",
        [
            (1, 0, '<!-- figure:start type=chart label="Fig. 1" -->\n**Fig. 1 (chart):** A caption\n\nDescription: More.\n<!-- figure:end -->', '[Figure: More.]'),
            (1, 1, '<!-- figure:start type=photo label="None" -->\n**None (photo):** \n\nDescription: Only described\n<!-- figure:end -->', '[Figure: Only described]'),
            (1, 2, '<!-- figure:start type=table label="T" -->\n**T (table):** Same\n<!-- figure:end -->', '[Figure: Same]'),
            (2, 0, '<!-- figure:start type=map label="M" -->\n**M (map):** \n<!-- figure:end -->', '[Figure: M]'),
        ],
    ),
    "blocks_rendered": Fixture(
        "id int, markdown string, plain string",
        [
            (1, '## Title', 'Title'),
            (2, '> نص **[2:255]**', 'نص [2:255]'),
            (3, '> نص', 'نص'),
            (4, '> بسم الله', 'بسم الله'),
            (5, '---\nnote', 'note'),
            (6, '**Isnad:** chain', 'Isnad: chain'),
            (7, '**Matn:** text', 'Matn: text'),
            (8, '> recited **[1:1]**', 'recited [1:1]'),
            (9, '> told *(Bukhari 1)*', 'told (Bukhari 1)'),
            (10, 'plain', 'plain'),
            (11, None, None),
        ],
    ),
    "structured_documents": Fixture(
        "id int, block_seq int, type string, text string",
        [
            (1, 1, 'heading', 'Head'),
            (1, 2, 'paragraph', 'body text'),
            (1, 3, 'verse', 'x = 1'),
            (2, 1, 'heading', 'Head'),
            (2, 2, 'paragraph', 'text'),
            (3, 1, 'paragraph', 'only plain'),
            (5, 1, 'paragraph', 'loose alt'),
        ],
    ),
    "blocks_of_words": Fixture(
        "doc_id long, block_seq int, type string, text string, page int, verse_key string, hadith_ref string, dominant_role string",
        [
            (1, 1, 'heading', 'Head', 1, None, None, 'body'),
            (1, 2, 'verse', 'آية', 1, '1:1', None, 'quran'),
            (1, 3, 'verse', 'ثانية', 1, '1:2', None, 'quran'),
            (1, 4, 'paragraph', 'spoken', 1, None, 'B1', 'hadith'),
            (1, 5, 'paragraph', 'other', 1, None, 'B2', 'hadith'),
            (1, 6, 'paragraph', 'para', 1, None, None, 'body'),
            (1, 7, 'paragraph', 'next', 1, None, None, 'body'),
            (1, 8, 'paragraph', 'page', 2, None, None, 'body'),
            (2, 1, 'paragraph', 'b c', 7, None, None, 'body'),
        ],
    ),
    "source_blocks": Fixture(
        "ord int, kind string, text string, part_a string, part_b string, part_c string",
        [
            (1, 'BASMALA', 'بسم الله الرحمن الرحيم', '', '', ''),
            (2, 'HADITH_UNIT', '', 'حدثنا فلان', 'قال كذا', 'صحيح'),
            (3, 'VERSE_PAIR', '', 'شطر أول', 'شطر ثان', ''),
            (4, 'HAMDALA', 'الحمد لله رب العالمين والصلاة', '', '', ''),
            (5, 'LACUNA', '', '', '', ''),
            (6, 'QURAN_CITATION', 'قال ﴿ألم﴾', '', '', ''),
            (7, 'PARAGRAPH', 'نص PageV01P002 بعده ms12 ثم Milestone300', '', '', ''),
            (8, 'PARAGRAPH', 'متن $ عنوان $ بقية + قلت هذا تعليق', '', '', ''),
            (9, 'PARAGRAPH', '#META# 010.AuthorNAME :: Ghazali', '', '', ''),
            (10, 'PARAGRAPH', '#META# 020.BookTITLE :: NODATA', '', '', ''),
        ],
    ),
    "source_inline": Fixture(
        "ord int, part int, kind string, text string, volume int, page int",
        [
            (1, 0, 'BODY', 'بسم الله الرحمن الرحيم', None, None),
            (2, 0, 'BODY', '$RWY$ حدثنا فلان @MATN@ قال كذا @HUKM@ صحيح', None, None),
            (3, 0, 'BODY', 'شطر أول %~% شطر ثان', None, None),
            (4, 0, 'BODY', 'الحمد لله رب العالمين والصلاة', None, None),
            (5, 0, 'BODY', '........', None, None),
            (6, 0, 'BODY', 'قال ﴿ألم﴾', None, None),
            (7, 0, 'BODY', 'نص', None, None),
            (7, 1, 'PAGE_REF', '', 1, 2),
            (7, 2, 'BODY', 'بعده ثم', None, None),
            (8, 0, 'BODY', 'متن', None, None),
            (8, 1, 'TITLE', 'عنوان', None, None),
            (8, 2, 'TITLE', 'بقية + قلت هذا تعليق', None, None),
            (9, 0, 'BODY', '#META# 010.AuthorNAME :: Ghazali', None, None),
            (10, 0, 'BODY', '#META# 020.BookTITLE :: NODATA', None, None),
        ],
    ),
    "parsed_payloads": Fixture(
        "id int, ord int, page int, volume int, type string, text string",
        [
            (1, 0, 1, None, 'heading', 'كتاب'),
            (1, 2, 12, 1, 'verse', 'بيت أول // بيت ثان'),
            (1, 3, 12, 1, 'paragraph', 'Year: 505'),
            (1, 5, 1, None, 'paragraph', 'x y'),
            (1, 8, 1, None, 'paragraph', 'rest'),
            (2, 0, 1, None, 'heading', 'باب'),
            (2, 1, 1, None, 'verse', 'اقتباس'),
            (3, 0, 1, None, 'paragraph', 'p'),
            (3, 2, 3, 2, 'paragraph', 'Year of birth: 450'),
            (3, 3, 3, 2, 'paragraph', 'q'),
        ],
    ),
    "payload_pages": Fixture(
        "id int, pages string, title string",
        [
            (1, '1,12', 'كتاب'),
            (2, '1', ''),
            (3, '1,3', ''),
        ],
    ),
    "payload_layout": Fixture(
        "id int, ord int, part int, kind string, text string, level int, volume int, page int",
        [
            (1, 0, 0, 'PAGE_REF', '', None, 1, 5),
            (1, 1, 0, 'TITLE', 'عنوان', None, None, None),
            (1, 2, 0, 'HEADING_3', 'باب', 3, None, None),
            (1, 3, 0, 'HEADING_5', 'عميق', 9, None, None),
            (1, 4, 0, 'VERSE_PAIR', 'شطر آخر', None, None, None),
            (1, 5, 0, 'VERSE_LINE', 'سطر', None, None, None),
            (1, 6, 0, 'MORPHO_TAG', '', None, None, None),
            (1, 7, 0, 'PARAGRAPH', 'نص', None, None, None),
            (1, 7, 1, 'PAGE_REF', '', None, 1, 7),
            (1, 7, 2, 'PARAGRAPH', 'بقية', None, None, None),
            (1, 7, 3, 'TITLE', 'عنوان فرعي + باق', 2, None, None),
            (1, 8, 0, 'PARAGRAPH', 'متن', None, None, None),
            (1, 8, 1, 'APPARATUS_NOTE', 'قلت تعليق', None, None, None),
            (1, 8, 2, 'PARAGRAPH', 'زيادة', None, None, None),
            (1, 10, 0, 'BIO_MAN', 'سيرة', None, None, None),
            (1, 11, 0, 'QURAN_CITATION', 'قال ﴿ألم﴾', None, None, None),
        ],
    ),
    "source_prefixes": Fixture(
        "ord int, line string, bare string",
        [
            (1, '# بسم الله الرحمن الرحيم', 'بسم الله الرحمن الرحيم'),
            (2, '# $RWY$ حدثنا فلان @MATN@ قال كذا @HUKM@ صحيح', '$RWY$ حدثنا فلان @MATN@ قال كذا @HUKM@ صحيح'),
            (3, '# شطر أول %~% شطر ثان', 'شطر أول %~% شطر ثان'),
            (4, '# الحمد لله رب العالمين والصلاة', 'الحمد لله رب العالمين والصلاة'),
            (5, '# ........', '........'),
            (6, '# قال ﴿ألم﴾', 'قال ﴿ألم﴾'),
            (7, '# نص PageV01P002 بعده ms12 ثم Milestone300', 'نص بعده ثم'),
            (8, '# متن $ عنوان $ بقية + قلت هذا تعليق', 'متن $ عنوان $ بقية + قلت هذا تعليق'),
            (9, '#META# 010.AuthorNAME :: Ghazali', '#META# 010.AuthorNAME :: Ghazali'),
            (10, '#META# 020.BookTITLE :: NODATA', '#META# 020.BookTITLE :: NODATA'),
        ],
    ),
    "source_urls": Fixture(
        "id int, raw string",
        [
            (1, 'https://raw.githubusercontent.com/OpenITI/0575AH/master/data/book/version-ara1'),
            (2, None),
            (3, None),
            (4, None),
            (5, 'https://raw.githubusercontent.com/openiti/repo/main/x'),
            (6, None),
            (7, None),
            (8, None),
            (9, None),
            (10, 'https://raw.githubusercontent.com/OpenITI/r/main/x'),
            (11, 'https://raw.githubusercontent.com/openiti/r/x'),
            (12, None),
            (13, 'https://raw.githubusercontent.com/OpenITI/r/main/x'),
        ],
    ),
    "source_structures": Fixture(
        "id int, structure_id string, sequence int, paragraph_id string, heading string, text string, flags string",
        [
            (1, 'en:u0000', 0, 'en:u0000:p0000', 'CHAPTER 1', 'The first passage.', ''),
            (1, 'en:u0001', 0, 'en:u0001:p0000', 'CHAPTER 2', 'The second passage.', ''),
            (2, 'en:u0000', 0, 'en:u0000:p0000', '', 'License preface.', 'exclude_from_alignment,gutenberg_boilerplate'),
            (2, 'en:u0000', 1, 'en:u0000:p0001', '', '*** START OF THE PROJECT GUTENBERG EBOOK DEMO ***', 'exclude_from_alignment,gutenberg_boilerplate'),
            (2, 'en:u0001', 0, 'en:u0001:p0000', 'CHAPTER 1', 'The translated body.', ''),
            (2, 'en:u0001', 1, 'en:u0001:p0001', 'CHAPTER 1', '[Footnote 1: An editorial note.]', 'exclude_from_alignment,footnote'),
            (2, 'en:u0001', 2, 'en:u0001:p0002', 'CHAPTER 1', '*** END OF THE PROJECT GUTENBERG EBOOK DEMO ***', 'exclude_from_alignment,gutenberg_boilerplate'),
            (2, 'en:u0001', 3, 'en:u0001:p0003', 'CHAPTER 1', 'License footer.', 'exclude_from_alignment,gutenberg_boilerplate'),
            (3, 'en:u0000', 0, 'en:u0000:p0000', '', 'A complete English paragraph.', ''),
            (4, 'en:u0000', 0, 'en:u0000:p0000', '', 'I went home yesterday', ''),
            (4, 'en:u0000', 1, 'en:u0000:p0001', '', '12 men came to the city', ''),
            (4, 'en:u0001', 0, 'en:u0001:p0000', 'IV. of things', 'last words', ''),
            (5, 'en:u0000', 0, 'en:u0000:p0000', '', 'PART ONE', ''),
            (5, 'en:u0000', 1, 'en:u0000:p0001', '', 'BOOK II', ''),
            (7, 'en:u0000', 0, 'en:u0000:p0000', '', 'not *** START OF PROJECT GUTENBERG', ''),
            (7, 'en:u0000', 1, 'en:u0000:p0001', '', 'Short OF MOSTLY CAPITALS', ''),
        ],
    ),
    "align_paragraphs": Fixture(
        "work string, link int, ar_ids string, en_ids string, operation string, score double, confidence double, radius int, flags string",
        [
            ('w1', 0, 'ar:u0000:p0000', 'en:u0000:p0000', '1-1', 1.0, 0.94, 0, 'hard_landmark,number:437,name:qshr'),
            ('w1', 1, 'ar:u0000:p0001', 'en:u0000:p0001', '1-1', 0.42, 0.6125, 2, ''),
            ('w1', 2, 'ar:u0000:p0002', 'en:u0000:p0002', '1-1', 1.0, 0.94, 0, 'hard_landmark,number:12'),
            ('w1', 3, 'ar:u0000:p0003', 'en:u0000:p0003', '1-1', 0.2, 0.475, 2, 'low_signal'),
            ('w2', 0, 'ar:u0000:p0000', 'en:u0000:p0000,en:u0000:p0001', '1-2', -0.128571, 0.269643, 2, 'low_signal'),
            ('w3', 0, 'ar:u0000:p0000', '', '1-0', -1.1, 0.12, 3, 'arabic_omission'),
            ('w4', 0, 'ar:u0000:p0000', 'en:u0000:p0000', '1-1', 0.2, 0.475, 2, 'low_signal'),
            ('w4', 1, 'ar:u0001:p0000', 'en:u0001:p0000', '1-1', 1.0, 0.94, 0, 'hard_landmark,number:21'),
            ('w5', 0, 'ar:u0000:p0000,ar:u0000:p0001', 'en:u0000:p0000,en:u0000:p0001', '2-2', 0.1, 0.4125, 2, 'low_signal'),
        ],
    ),
    "align_sentences": Fixture(
        "work string, parent int, link int, ar_ids string, en_ids string, operation string, confidence double, radius int, flags string",
        [
            ('w1', 0, 0, 'ar:u0000:p0000:s0000', 'en:u0000:p0000:s0000', '1-1', 0.76875, 1, ''),
            ('w1', 1, 0, 'ar:u0000:p0001:s0000', 'en:u0000:p0001:s0000', '1-1', 0.6125, 2, ''),
            ('w1', 2, 0, 'ar:u0000:p0002:s0000', 'en:u0000:p0002:s0000', '1-1', 0.63125, 2, ''),
            ('w1', 3, 0, 'ar:u0000:p0003:s0000', 'en:u0000:p0003:s0000', '1-1', 0.475, 2, 'low_signal'),
            ('w4', 0, 0, 'ar:u0000:p0000:s0000', 'en:u0000:p0000:s0000', '1-1', 0.475, 2, 'low_signal'),
            ('w4', 1, 0, 'ar:u0001:p0000:s0000', 'en:u0001:p0000:s0000', '1-1', 0.63125, 2, ''),
        ],
    ),
    "align_recommend": Fixture(
        "work string, link int, resolution string, ar_ids string, en_ids string, confidence double, radius int, reason string, flags string",
        [
            ('w1', 0, 'sentence', 'ar:u0000:p0000:s0000', 'en:u0000:p0000:s0000', 0.76875, 1, 'sentence_path_above_threshold', ''),
            ('w1', 1, 'sentence', 'ar:u0000:p0001:s0000', 'en:u0000:p0001:s0000', 0.6125, 2, 'sentence_path_above_threshold', ''),
            ('w1', 2, 'sentence', 'ar:u0000:p0002:s0000', 'en:u0000:p0002:s0000', 0.63125, 2, 'sentence_path_above_threshold', ''),
            ('w1', 3, 'paragraph', 'ar:u0000:p0003', 'en:u0000:p0003', 0.475, 2, 'sentence_evidence_too_weak', 'low_signal'),
            ('w2', 0, 'region', 'ar:u0000:p0000', 'en:u0000:p0000,en:u0000:p0001', 0.269643, 3, 'paragraph_evidence_too_weak', 'local_region_fallback,low_signal'),
            ('w3', 0, 'structure', 'ar:u0000', '', 0.2, 3, 'one_sided_omission_or_addition', 'arabic_omission,review_required,unanchored_structure'),
            ('w4', 0, 'paragraph', 'ar:u0000:p0000', 'en:u0000:p0000', 0.475, 2, 'sentence_evidence_too_weak', 'low_signal'),
            ('w4', 1, 'sentence', 'ar:u0001:p0000:s0000', 'en:u0001:p0000:s0000', 0.63125, 2, 'sentence_path_above_threshold', ''),
            ('w5', 0, 'region', 'ar:u0000:p0000,ar:u0000:p0001', 'en:u0000:p0000,en:u0000:p0001', 0.4125, 3, 'paragraph_evidence_too_weak', 'local_region_fallback,low_signal'),
        ],
    ),
    "review_queue": Fixture(
        "work string, review_id string, link int, priority string, ar_ids string, en_ids string, resolution string, confidence double, radius int, reasons string, status string, evidence string",
        [
            ('w1', 'review:0b5e1546f7f50694a98e', 1, 'low', 'ar:u0000:p0001:s0000', 'en:u0000:p0001:s0000', 'sentence', 0.6125, 2, 'low_score_confidence,nonzero_uncertainty_radius', 'pending', 'sentence_path_above_threshold'),
            ('w1', 'review:4d8a0f11d100cbd2b07e', 2, 'low', 'ar:u0000:p0002:s0000', 'en:u0000:p0002:s0000', 'sentence', 0.63125, 2, 'low_score_confidence,nonzero_uncertainty_radius', 'pending', 'sentence_path_above_threshold'),
            ('w1', 'review:7a45d951e2d459f71bb3', 0, 'low', 'ar:u0000:p0000:s0000', 'en:u0000:p0000:s0000', 'sentence', 0.76875, 1, 'nonzero_uncertainty_radius', 'pending', 'sentence_path_above_threshold'),
            ('w1', 'review:80371f815b3bf019d0ce', 3, 'medium', 'ar:u0000:p0003', 'en:u0000:p0003', 'paragraph', 0.475, 2, 'low_score_confidence,low_signal,nonzero_uncertainty_radius,zoomed_out_to_paragraph', 'pending', 'sentence_evidence_too_weak'),
            ('w2', 'review:29e571aa92f95ab21864', 0, 'high', 'ar:u0000:p0000', 'en:u0000:p0000,en:u0000:p0001', 'region', 0.269643, 3, 'local_region_fallback,low_score_confidence,low_signal,nonzero_uncertainty_radius,zoomed_out_to_region', 'pending', 'paragraph_evidence_too_weak'),
            ('w3', 'review:a56ea3d4e4847e0974bb', 0, 'high', 'ar:u0000', '', 'structure', 0.2, 3, 'arabic_omission,low_score_confidence,nonzero_uncertainty_radius,review_required,unanchored_structure,zoomed_out_to_structure', 'pending', 'one_sided_omission_or_addition'),
            ('w4', 'review:14e9ed380aa23437dbbe', 0, 'medium', 'ar:u0000:p0000', 'en:u0000:p0000', 'paragraph', 0.475, 2, 'low_score_confidence,low_signal,nonzero_uncertainty_radius,zoomed_out_to_paragraph', 'pending', 'sentence_evidence_too_weak'),
            ('w4', 'review:5043f1d15936be2c0f9f', 1, 'low', 'ar:u0001:p0000:s0000', 'en:u0001:p0000:s0000', 'sentence', 0.63125, 2, 'low_score_confidence,nonzero_uncertainty_radius', 'pending', 'sentence_path_above_threshold'),
            ('w5', 'review:da2c2d706d67e50b6a18', 0, 'high', 'ar:u0000:p0000,ar:u0000:p0001', 'en:u0000:p0000,en:u0000:p0001', 'region', 0.4125, 3, 'local_region_fallback,low_score_confidence,low_signal,nonzero_uncertainty_radius,zoomed_out_to_region', 'pending', 'paragraph_evidence_too_weak'),
        ],
    ),
    "alignment_diagnostics": Fixture(
        "work string, arabic_paragraphs long, english_paragraphs long, structural_links long, coarse_intervals long, paragraph_links long, hard_landmarks long, sentence_links long, sentence_level long, paragraph_level long, region_level long, structure_level long, high_priority long, medium_priority long, low_priority long, arabic_coverage double, english_coverage double",
        [
            ('w1', 4, 4, 1, 0, 4, 2, 4, 3, 1, 0, 0, 0, 1, 3, 1.0, 1.0),
            ('w2', 1, 2, 1, 0, 1, 0, 0, 0, 0, 1, 0, 1, 0, 0, 1.0, 1.0),
            ('w3', 1, 0, 1, 0, 1, 0, 0, 0, 0, 0, 1, 1, 0, 0, 1.0, 1.0),
            ('w4', 2, 2, 2, 0, 2, 1, 2, 1, 1, 0, 0, 0, 1, 1, 1.0, 1.0),
            ('w5', 2, 2, 1, 0, 1, 0, 0, 0, 0, 1, 0, 1, 0, 0, 1.0, 1.0),
        ],
    ),
    "structural_pairs": Fixture(
        "work string, pair int, ar_ids string, en_ids string, method string, confidence double, flags string, evidence string",
        [
            ('w1', 0, 'ar:u0000', 'en:u0000', 'whole_book_unanchored', 0.2, 'unanchored_structure,review_required', ''),
            ('w2', 0, 'ar:u0000', 'en:u0000', 'whole_book_unanchored', 0.2, 'unanchored_structure,review_required', ''),
            ('w3', 0, 'ar:u0000', '', 'whole_book_unanchored', 0.2, 'unanchored_structure,review_required', ''),
            ('w4', 0, 'ar:u0000', 'en:u0000', 'bilateral_structure_sequence', 0.92, '', 'number:1'),
            ('w4', 1, 'ar:u0001', 'en:u0001', 'bilateral_structure_sequence', 0.92, '', 'number:2'),
            ('w5', 0, 'ar:u0000', 'en:u0000', 'whole_book_unanchored', 0.2, 'unanchored_structure,review_required', ''),
        ],
    ),
    "sentence_numbers": Fixture(
        "work string, lang string, id string, paragraph string, global_sequence int",
        [
            ('w1', 'ar', 'ar:u0000:p0000:s0000', 'ar:u0000:p0000', 0),
            ('w1', 'ar', 'ar:u0000:p0001:s0000', 'ar:u0000:p0001', 1),
            ('w1', 'ar', 'ar:u0000:p0002:s0000', 'ar:u0000:p0002', 2),
            ('w1', 'ar', 'ar:u0000:p0003:s0000', 'ar:u0000:p0003', 3),
            ('w1', 'en', 'en:u0000:p0000:s0000', 'en:u0000:p0000', 0),
            ('w1', 'en', 'en:u0000:p0001:s0000', 'en:u0000:p0001', 1),
            ('w1', 'en', 'en:u0000:p0002:s0000', 'en:u0000:p0002', 2),
            ('w1', 'en', 'en:u0000:p0003:s0000', 'en:u0000:p0003', 3),
            ('w2', 'ar', 'ar:u0000:p0000:s0000', 'ar:u0000:p0000', 0),
            ('w2', 'en', 'en:u0000:p0000:s0000', 'en:u0000:p0000', 0),
            ('w2', 'en', 'en:u0000:p0001:s0000', 'en:u0000:p0001', 1),
            ('w3', 'ar', 'ar:u0000:p0000:s0000', 'ar:u0000:p0000', 0),
            ('w4', 'ar', 'ar:u0000:p0000:s0000', 'ar:u0000:p0000', 0),
            ('w4', 'ar', 'ar:u0001:p0000:s0000', 'ar:u0001:p0000', 1),
            ('w4', 'en', 'en:u0000:p0000:s0000', 'en:u0000:p0000', 0),
            ('w4', 'en', 'en:u0001:p0000:s0000', 'en:u0001:p0000', 1),
            ('w5', 'ar', 'ar:u0000:p0000:s0000', 'ar:u0000:p0000', 0),
            ('w5', 'ar', 'ar:u0000:p0001:s0000', 'ar:u0000:p0001', 1),
            ('w5', 'en', 'en:u0000:p0000:s0000', 'en:u0000:p0000', 0),
            ('w5', 'en', 'en:u0000:p0001:s0000', 'en:u0000:p0001', 1),
        ],
    ),
    "alignment_faults": Fixture(
        "fault string, valid long, broken long",
        [
            ('paragraph_clamp', 0, 2),
            ('paragraph_link', 0, 1),
            ('recommendation', 0, 1),
            ('review', 0, 2),
            ('sentence_clamp', 0, 3),
            ('sentence_link', 0, 1),
            ('sentence_parent', 0, 0),
            ('structure_clamp', 0, 1),
        ],
    ),
    "review_judged": Fixture(
        "work string, link int, status string",
        [
            ('w1', 0, 'needs_review'),
            ('w1', 1, 'needs_review'),
            ('w1', 2, 'model_accepted'),
            ('w1', 3, 'pending'),
            ('w2', 0, 'needs_review'),
            ('w3', 0, 'needs_review'),
            ('w4', 0, 'needs_review'),
            ('w4', 1, 'needs_review'),
            ('w5', 0, 'needs_review'),
        ],
    ),
    "corrections_applied": Fixture(
        "work string, link int, resolution string, ar_ids string, en_ids string, confidence double, radius int, flags string",
        [
            ('w1', 0, 'sentence', 'ar:u0000:p0000:s0000', 'en:u0000:p0000:s0000', 0.76875, 1, ''),
            ('w1', 1, 'sentence', 'ar:u0000:p0001:s0000', 'en:u0000:p0001:s0000', 0.6125, 2, 'human_rejected'),
            ('w1', 2, 'paragraph', 'ar:u0000:p0000', 'en:u0000:p0002:s0000', 1.0, 0, ''),
            ('w1', 3, 'paragraph', 'ar:u0000:p0000', 'en:u0000:p0003', 1.0, 0, 'low_signal'),
            ('w2', 0, 'region', 'ar:u0000:p0000', 'en:u0000:p0000,en:u0000:p0001', 0.269643, 3, 'local_region_fallback,low_signal'),
            ('w3', 0, 'structure', 'ar:u0000', '', 0.2, 3, 'arabic_omission,review_required,unanchored_structure'),
            ('w4', 0, 'paragraph', 'ar:u0000:p0000', 'en:u0000:p0000', 0.475, 2, 'low_signal'),
            ('w4', 1, 'sentence', 'ar:u0001:p0000:s0000', 'en:u0001:p0000:s0000', 0.63125, 2, 'human_rejected'),
            ('w5', 0, 'region', 'ar:u0000:p0000,ar:u0000:p0001', 'en:u0000:p0000,en:u0000:p0001', 0.4125, 3, 'local_region_fallback,low_signal'),
        ],
    ),
    "corrections_stale": Fixture(
        "review_id string, fault string",
        [
            (None, 'duplicate'),
            ('review:none', 'stale'),
        ],
    ),
    "gold_metrics": Fixture(
        "work string, gold_links long, exact double, buffer_1 double, buffer_2 double, paragraph_correct double, catastrophic double, reanchor_mean double, reanchor_max int",
        [
            ('g1', 4, 0.25, 0.75, 0.75, 0.5, 0.5, None, None),
        ],
    ),
    "region_metrics": Fixture(
        "work string, gold_regions long, scored_regions long, mapping_failures long, exact double, contains_gold_region double, buffer_1 double, buffer_2 double, paragraph_correct double, catastrophic double, span_precision_mean double, span_recall_mean double",
        [
            ('w1', 1, 1, 0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.0, 1.0, 1.0),
            ('w5', 3, 2, 1, 0.5, 1.0, 1.0, 1.0, 1.0, 0.0, 0.75, 1.0),
        ],
    ),
    "capability_profile": Fixture(
        "id int, profile string, scope string, judge string, notes string",
        [
            (1, 'balanced', 'paragraph', None, 'No model is downloaded or started automatically. Paragraph-only semantic retrieval limits memory use.'),
            (2, 'balanced', 'paragraph', None, 'No model is downloaded or started automatically. No suitable installed generative Ollama model was detected.'),
            (3, 'thorough', 'paragraph_and_sentence', None, 'No model is downloaded or started automatically. Runnable Ollama models were detected, but no judge is recommended without calibration gold.'),
            (4, 'balanced', 'paragraph', None, 'No model is downloaded or started automatically. No suitable installed generative Ollama model was detected.'),
            (5, 'basic', 'none', None, 'No model is downloaded or started automatically. Install the optional semantic extra for cross-language retrieval.'),
            (6, 'thorough', 'paragraph_and_sentence', None, 'No model is downloaded or started automatically. No suitable installed generative Ollama model was detected.'),
            (7, 'balanced', 'paragraph', None, 'No model is downloaded or started automatically.'),
        ],
    ),
    "transliterations": Fixture(
        "id int, annotated string",
        [
            (1, 'wisdom (hikma الحكمة) by (al-Qushayri1 القشيري) and (nobody)'),
            (2, 'none'),
        ],
    ),
    "hyphens_joined": Fixture(
        "line string, ord int, original string, normalized string, honorific string, hyphen_start boolean, hyphen_end boolean",
        [
            ('a', 0, 'Prophet', 'Prophet', 'SAW', False, False),
            ('a', 2, 'hy-', 'hyphen', None, True, True),
            ('a', 4, 'end', 'end', None, False, False),
        ],
    ),
    "batch_reversal": Fixture(
        "page int, is_reversed boolean",
        [
            (1, False),
            (2, True),
        ],
    ),
    "extraction_markdown": Fixture(
        "doc_id long, markdown string, plain_text string, n_blocks long",
        [
            (0, 'aṣ īb\n\ncß d¤\n\n> ße', 'aṣ īb\n\ncß d¤\n\nße', 3),
        ],
    ),
    "extraction_stats": Fixture(
        "doc_id long, total_pages long, unsupported_pages string, ocr_pages string, word_count long",
        [
            (0, 2, '1', '1', 5),
        ],
    ),
    "page_repair": Fixture(
        "page int, original_text string, repaired_text string, word_count long",
        [
            (1, 'aß ¬b cß d¤', 'aṣ īb cß d¤', 4),
            (2, 'ße', 'ße', 1),
        ],
    ),
    "translation_tables": Fixture(
        "work string, arabic_paragraphs long, english_paragraphs long, structural_links long, coarse_intervals long, paragraph_links long, hard_landmarks long, sentence_links long, sentence_level long, paragraph_level long, region_level long, structure_level long, high_priority long, medium_priority long, low_priority long, arabic_coverage double, english_coverage double",
        [
            ('w1', 4, 4, 1, 0, 4, 2, 4, 3, 1, 0, 0, 0, 1, 3, 1.0, 1.0),
            ('w2', 1, 2, 1, 0, 1, 0, 0, 0, 0, 1, 0, 1, 0, 0, 1.0, 1.0),
            ('w3', 1, 0, 1, 0, 1, 0, 0, 0, 0, 0, 1, 1, 0, 0, 1.0, 1.0),
            ('w4', 2, 2, 2, 0, 2, 1, 2, 1, 1, 0, 0, 0, 1, 1, 1.0, 1.0),
            ('w5', 2, 2, 1, 0, 1, 0, 0, 0, 0, 1, 0, 1, 0, 0, 1.0, 1.0),
        ],
    ),
}
