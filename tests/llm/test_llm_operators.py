"""The ten operators against brute force, on small tables with nulls, ties, repeats and odd columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codexa.llm import bpe_codec, exact_dedup, fingerprints, license_scan, line_dedup, lm_scores, near_dedup, packing, quality, url_filter
from codexa.llm.bpe import Bpe
from codexa.llm.components import components
from codexa.llm.text import HashIndex, mix, texts

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

ODD = [None, "", " \n\t ", "a", "ab", "word word word", "Ünïcode ﬁ 😀😀 日本語 ١٢", "<|endoftext|>x <|startoftext|>", "don't I'LL 's  'x", "x" * 5000, "line one\nline one\n\nline two 17", "!!! ... ???"]


def docs_of(spark, rows, extra=True):
    """Rows (id, text), with columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        df = df.withColumns({c: F.lit("clash") for c in ("id", "row", "key", "score", "predicted", "keep_id", "sig", "n", "words", "number", "numbers")})
    return df.repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    rows = list(enumerate(ODD)) + [(None, "null id"), (3, "a"), (3, "a"), (50, "null id")]
    return docs_of(spark, rows).cache()


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


@pytest.fixture(scope="module")
def tiny_docs(spark, tiny):
    return spark.read.parquet(f"{tiny}/documents.parquet")


# -- shared parts ------------------------------------------------------------------------------
def test_hash_index_numbers_all_keys():
    index, seen = HashIndex(8), {}
    rng = np.random.default_rng(0)
    for _ in range(20):
        keys = mix(rng.integers(0, 500, 300).astype(np.uint64))
        for k, n in zip(keys.tolist(), index.number(keys)[0].tolist(), strict=True):
            assert seen.setdefault(k, n) == n
    assert sorted(seen.values()) == list(range(len(seen)))


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 80, (60, 2))] + [(100 + k, 101 + k) for k in range(30)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = sorted((root(a), root(b)))
        parent[rb] = ra
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


# -- 1 -----------------------------------------------------------------------------------------
def test_fingerprints(spark, odd, none):
    rows = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    got = fingerprints.edited_fingerprints(odd).collect()
    assert len(got) == len(rows)
    order = sorted({r for r in rows if r[0] is not None and r[0] != 3}, key=lambda r: -r[0])
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r)
    for (own, text), (_, after) in zip(order, order[1:], strict=False):
        if own == 4:
            after = "a"  # the first of the rows of id 3
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        r = by_id[own][0]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["edited_fingerprint"] == fingerprints.as_hex(fingerprints.fingerprint(edited))
        assert r["fingerprint"] == fingerprints.as_hex(fingerprints.fingerprint(text))
    assert len({r["fingerprint"] for r in by_id[3]}) == 1
    assert fingerprints.edited_fingerprints(none).count() == 0


def test_fingerprints_over_many_ranges(spark, tiny_docs):
    rows = sorted(((r["doc_id"], r["text"]) for r in tiny_docs.collect()), reverse=True)
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(tiny_docs).collect()}
    for k, (own, text) in enumerate(rows):
        third, after = len(text) // 3, rows[(k + 1) % len(rows)][1]
        assert got[own]["edited_sha256"] == hashlib.sha256((text[: len(text) - third] + after[:third]).encode()).hexdigest()
        assert 0 <= got[own]["near_next"] <= got[own]["near_edited"] <= 1 or text == after or len(text) < 40


def brute_order_minhash(hashes, sketches, size):
    """The definition in plain Python: label every (k-mer, number of its occurrence), take the least, put them in text order."""
    one = lambda x: int(mix(np.array([x % (1 << 64)], np.uint64))[0])
    seen, labels = Counter(), []
    for h in hashes.tolist():
        labels.append(one(h + seen[h] * 0xD1342543DE82EF95))
        seen[h] += 1
    out = []
    for j in range(sketches):
        value = [((x >> 32) * int(fingerprints.FACTORS[j]) + int(fingerprints.SHIFTS[j])) % (1 << 32) for x in labels]
        entry = 0
        for r, i in enumerate(sorted(sorted(range(len(labels)), key=lambda i: value[i])[:size])):
            entry = one(entry * 31 + labels[i] + r + 1)
        out.append(entry)
    return out


def test_order_minhash_is_the_least_labelled_kmers():
    rng = np.random.default_rng(3)
    for text in ["abcabcabdabc" * 3, "abcd", "a" * 40, *("".join(rng.choice(list("abcdef "), n)) for n in (31, 32, 33, 300))]:
        hashes = fingerprints.kmers(fingerprints.code_units(text), 3)
        assert len(set(fingerprints.labelled(hashes).tolist())) == len(hashes)
        assert fingerprints.order_minhash(hashes, 5, 2).tolist() == brute_order_minhash(hashes, 5, 2)


@pytest.mark.parametrize("size", [120, 255, 256, 257, 1020, 1032, 2045, 4100, 8190, 16384])
def test_fingerprints_do_not_depend_on_length(size):
    """A few characters more or less change little, on whichever side of a power of two the counts lie."""
    text = "".join(np.random.default_rng(size).choice(list("abcdefghij klm"), size + 40))
    own = fingerprints.fingerprint(text[:size])
    for more in (1, 4, 12):
        least = 1 - 6 * (more + fingerprints.K) / size
        assert fingerprints.likeness(own, fingerprints.fingerprint(text[: size + more])) >= max(least, 0.5) - 0.1
    assert fingerprints.likeness(own, fingerprints.fingerprint(text[size:] * (size // 40 + 1))) < 0.2


# -- 2 and 8 -------------------------------------------------------------------------------------
@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_is_the_library(name, tiny_docs):
    own, lib = Bpe(P.path(name)), tokenizers.Tokenizer.from_file(P.path(name))
    lib.no_truncation()
    lib.no_padding()
    plain = [t or "" for t in ODD] + [r["text"] for r in tiny_docs.limit(60).collect()]
    plain += ["aaaaaaa" * 9, "ΑΣ. İstanbul", " ́abc", "\u0085 x", "  tail  ", "''' 's'", "it's we've they'll he'd I'm 'veX"]
    ids, at = own.encode(*texts(pa.array(plain)))
    for k, t in enumerate(plain):
        want = lib.encode(t, add_special_tokens=False).ids
        assert ids[at[k] : at[k + 1]].tolist() == want
        assert own.decode(ids[at[k] : at[k + 1]]) == lib.decode(want, skip_special_tokens=False)


def test_bpe_codec(spark, odd, none):
    path = P.path("word_bpe_49k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    want = Counter()
    for r in odd.collect():
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe_codec.digests(odd, path).collect()) == want
    assert {r["doc_id"]: len(r["ids"]) for r in bpe_codec.encode(odd, path).collect() if r["doc_id"] != 3} == {k[0]: k[1] for k in want if k[0] != 3}
    assert bpe_codec.digests(none, path).count() == 0


def test_packing(spark, odd, none, tiny_docs):
    path = P.path("byte_bpe_50k.json")
    lib = tokenizers.Tokenizer.from_file(path)
    for docs, size in ((odd, 2048), (tiny_docs, 2048), (odd, 64)):
        rows = packing.pack_documents(docs, path, size).collect()
        ids = {r["doc_id"]: [*lib.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
        bins, total = {}, 0
        for r in rows:
            own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
            assert len(own) == r["length"]
            assert zlib.crc32(np.array(own, "<u4").tobytes()) == r["ids_crc32"]
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
            total += r["length"]
        assert total == sum(len(ids[r["doc_id"]]) for r in docs.collect())
        for own in bins.values():
            own.sort()
            assert own[0][0] == 0
            assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False))
            assert sum(own[-1]) <= size
        assert len(bins) <= -(-total // size) * 1.15 + 2
        for key in ids:
            own = sorted({(r["piece"], r["start"], r["length"]) for r in rows if r["doc_id"] == key})
            assert all(n == size for _, _, n in own[1:])
    assert packing.pack_documents(none, path).count() == 0


def test_packing_in_rounds(spark):
    lengths = np.random.default_rng(5).integers(1, 2048, 3000)
    table = spark.createDataFrame([(int(k), int(n)) for k, n in enumerate(lengths)], "item long, length long").withColumn("doc_id", F.col("item"))
    out = packing.pack(table, group_rows=200).collect()
    assert len(out) == 3000
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        own.sort()
        assert own[0][0] == 0 and sum(own[-1]) <= 2048
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False))
    assert len(bins) <= lengths.sum() / 2048 * 1.06 + 1


def test_best_fit_on_ties():
    bins, offsets = packing.best_fit(np.array([5, 5, 5, 3, 3, 2, 2]), 10)
    assert bins.max() + 1 == 3
    assert sorted(zip(bins.tolist(), offsets.tolist(), strict=True))[0] == (0, 0)


# -- 3 -----------------------------------------------------------------------------------------
def test_line_dedup(spark):
    own = [f"unique body {k} " + " ".join(f"word{chr(97 + k)}x{chr(97 + i)}" for i in range(26)) for k in range(12)]
    body = [" ".join(chr(97 + (k * 7 + i * 3) % 26) * (2 + (i * k) % 5) for i in range(60)) for k in range(12)]
    passage = " ".join(f"passage{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(55))
    rows = [(k, "\n".join([own[k], body[k], "Read more at page %d of this site now" % k] + ([passage] if k in (2, 9) else []))) for k in range(12)]
    rows += [(100 + k, rows[1][1]) for k in range(5)]  # copies of a whole document
    got = {r["doc_id"]: r["dropped_lines"] for r in line_dedup.line_dedup(docs_of(spark, rows)).collect()}
    assert got[0] == [] and got[2] == [2] and got[9] == [2, 3]
    assert all(got[k] == [2] for k in (3, 4, 5, 6, 7, 8, 10, 11))
    clean = {r["doc_id"]: r["text"] for r in line_dedup.cleaned(docs_of(spark, rows)).collect()}
    assert passage in clean[2] and passage not in clean[9] and "Read more" not in clean[9] and body[9] in clean[9]


def test_line_dedup_generalises_fields(spark):
    names = "oak elm ash fir yew box bay fig".split()
    rows = [(k, " ".join(f"{n}{chr(97 + k)}{chr(97 + i)}" for i, n in enumerate(names * 6)) + f"\nPosted by user {names[k]} under the general terms of this site") for k in range(8)]
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.line_dedup(docs_of(spark, rows)).collect()}
    assert got == {0: 0} | dict.fromkeys(range(1, 8), 1)


def test_line_dedup_generalises_long_lines_from_two_documents(spark):
    words = lambda name, n: " ".join(f"{name}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(n))
    rows = [(k, words(f"own{chr(97 + k)}q", 40) + "\n" + words("pair", 30) + f" {name} " + words("tail", 29)) for k, name in enumerate(["smith", "jones"])]
    rows += [(10 + k, words("four", 24) + f" {name}") for k, name in enumerate(["oak", "elm", "ash", "fir"])]
    rows += [(20 + k, words("brief", 18) + f" {name}") for k, name in enumerate(["oak", "elm", "ash", "fir"])]
    got = {r["doc_id"]: r["dropped_lines"] for r in line_dedup.line_dedup(docs_of(spark, rows)).collect()}
    assert got == {0: [], 1: [1], 10: [], 11: [0], 12: [0], 13: [0]} | {20 + k: [] for k in range(4)}


def test_line_dedup_counts_every_distinct_document(spark):
    """Documents that a passage is most of are carriers; copies of one text are one carrier."""
    words = lambda name, n: " ".join(f"{name}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(n))
    passage, other, single = words("passage", 60), words("other", 30), words("single", 30)
    rows = [(k, passage + "\n" + words(f"own{chr(97 + k)}q", 40)) for k in range(6)]
    rows += [(10, other + "\n" + words("ordinary", 50))] + [(20 + k, words("copied", 50) + "\n" + other) for k in range(5)]
    rows += [(30 + k, single) for k in range(3)]
    got = {r["doc_id"]: r["dropped_lines"] for r in line_dedup.line_dedup(docs_of(spark, rows)).collect()}
    assert got == {0: []} | {k: [0] for k in range(1, 6)} | {10: []} | {20 + k: [1] for k in range(5)} | {30 + k: [] for k in range(3)}


def brute_line_dedup(rows):
    """The definition, over all pairs of lines: row -> numbers of the lines that go."""
    lines = []
    for own, text in rows:
        for number, line in enumerate((text or "").split("\n")):
            tokens = re.findall(r"[^\x09-\x0d ]+", line)
            field = [bool(re.search(r"[0-9@]|://", t)) for t in tokens]
            if tokens:
                lines.append((own, text or "", number, tuple("<*>" if f and 2 * sum(field) <= len(tokens) else t for t, f in zip(tokens, field, strict=True))))
    kinds = sorted({x[3] for x in lines})
    parent = {k: k for k in kinds}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(kinds):
        for b in kinds[:i]:
            if len(a) == len(b) >= 5 and a[:2] == b[:2] and sum(x != y for x, y in zip(a, b, strict=True)) <= math.floor(len(a) * 0.2 + 1e-9):
                parent[root(b)] = root(a)
    by_template = {}
    for own, text, number, tokens in lines:
        by_template.setdefault(root(tokens), []).append((own, text, number))
    gone = {(own, text or ""): set() for own, text in rows}
    for template, own in by_template.items():
        if len({t for _, t, _ in own}) >= (2 if len(template) >= 20 else 5):
            first = min(i for i, _, _ in own)
            for i, t, number in own:
                if i != first:
                    gone[i, t].add(number)
    return {k: sorted(v) for k, v in gone.items()}


def test_line_dedup_is_the_definition(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 3))
    kinds = [[word() for _ in range(int(n))] for n in rng.integers(1, 60, 25)]
    rows = []
    for k in range(90):
        own = []
        for _ in range(int(rng.integers(0, 7))):
            line = list(kinds[int(rng.integers(0, len(kinds)))])
            for _ in range(int(rng.integers(0, 2 + len(line) // 6))):
                line[int(rng.integers(0, len(line)))] = rng.choice([word(), "x1", "me@here", "a://b"])
            own.append(" ".join(line))
        rows.append((k, "\n".join(own)))
    rows += [(100 + k, rows[k][1]) for k in range(0, 40, 3)] + [(7, rows[7][1])]
    got = line_dedup.line_dedup(docs_of(spark, rows)).collect()
    want = brute_line_dedup(rows)
    texts_of = {}
    for own, text in rows:
        texts_of.setdefault(own, text)
    assert len(got) == len(rows) and sum(map(len, want.values())) > 100
    assert {(r["doc_id"], texts_of[r["doc_id"]]): r["dropped_lines"] for r in got} == want


def test_line_dedup_supports_from_different_documents(spark):
    """Two long lines that differ in one field recur, whatever other documents share other places with them."""
    words = lambda name, n: [f"{name}{chr(97 + i)}" for i in range(n)]
    pair = words("p", 22)
    rows = [(k, " ".join([*pair[:12], name, *pair[13:]])) for k, name in enumerate(["smith", "jones"])]
    rows += [(10 + k, " ".join([*pair[:2], *(w if (i + k) % 3 == 0 else f"{w}q{chr(97 + k)}" for i, w in enumerate(pair[2:]))])) for k in range(7)]
    got = {r["doc_id"]: r["dropped_lines"] for r in line_dedup.line_dedup(docs_of(spark, rows)).collect()}
    assert got == {0: [], 1: [0]} | {10 + k: [] for k in range(7)}


def test_line_dedup_on_odd_rows(spark, odd, none):
    got = line_dedup.line_dedup(odd)
    assert got.count() == odd.count()
    assert {r["doc_id"]: r["n_lines"] for r in got.collect()}[10] == 4
    assert line_dedup.cleaned(odd).columns == odd.columns
    assert line_dedup.line_dedup(none).count() == line_dedup.cleaned(none).count() == 0


def test_kept_steps_leave_no_shuffle_files(spark):
    """Shuffle files of a finished step go without a collection of the driver's garbage, and the session's setting stays."""
    import time

    from codexa.llm.store import drop, keep
    from codexa.sources.store import CLEANUP

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {n.rsplit("/", 1)[-1] for n in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in n}
    before, setting = shuffled(), spark.conf.get(CLEANUP)
    table = keep(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "test")
    until = time.time() + 10
    while (left := shuffled() - before) and time.time() < until:
        time.sleep(0.1)
    assert not left
    assert spark.conf.get(CLEANUP) == setting and sorted(r["count"] for r in table.collect()) == [142] + [143] * 6
    drop(table)


# -- 4 -----------------------------------------------------------------------------------------
def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET/en/x", "https://example.net", "https://example.net/de/", "x://org/fr/1", "ftp://a.b.org/fr/?q", "http://a.org/en/", "http://notexample.com/de/", "http://example.com/de/1#x", "http://net/", "http://evilnet/", "https://x.net?y/", "a://b://c/d", "http://a.net/#/en/"]
    rows = list(enumerate(urls)) + [(3, urls[3]), (None, urls[3])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit(1), "key": F.lit(2), "rule": F.lit(3)})
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")

    def judged(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fit)[1], max(fit)[2]) if fit else (host, path, None, "allow")

    want = Counter((k, *judged(u)) for k, u in rows)
    assert Counter(tuple(r) for r in url_filter.judge(pages, rules).collect()) == want
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_url_filter_with_many_rules(spark):
    rules = spark.createDataFrame([(f"h{k}.example", "/" + "p" * (k % 3), "block") for k in range(2000)], "host string, path string, verdict string")
    pages = spark.createDataFrame([(k, f"http://x.h{k}.example/pp/") for k in range(0, 4000, 7)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(pages, rules).collect()}
    assert got == {k: "block" if k < 2000 else "allow" for k in range(0, 4000, 7)}


# -- 5 -----------------------------------------------------------------------------------------
@pytest.mark.parametrize("size", [1 << 25, 200])
def test_exact_dedup(spark, odd, size, monkeypatch):
    if size == 200:
        monkeypatch.setattr(exact_dedup, "TASK_ROWS", 3)
    rows = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    got = exact_dedup.exact_dedup(odd, task_bytes=size, bucket_bytes=size).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(hashlib.sha256(t.encode()).hexdigest(), []).append(i)
    kept = Counter()
    for r in got:
        own = groups[r["text_sha256"]]
        assert r["doc_id"] in own and r["group_size"] == len(own)
        assert r["keep_id"] == max((i for i in own if i is not None), default=None)
        kept[r["text_sha256"]] += r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert kept == {k: 1 for k in groups}


def test_exact_dedup_of_a_hot_text(spark, none):
    rows = [(k, "same" if k % 3 else f"text {k // 6}") for k in range(600)]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(docs_of(spark, rows), task_bytes=50, bucket_bytes=100).collect()}
    assert got[1] == (599, 400) and got[0] == (3, 2)
    assert exact_dedup.exact_dedup(none).count() == 0


# -- 6 -----------------------------------------------------------------------------------------
@pytest.mark.parametrize("hot", [1 << 19, 40])
def test_lm_base(spark, tiny_docs, odd, hot):
    docs = tiny_docs.select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    cut = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)), None]
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    counts = Counter(w for i, t in rows if not held(i) for w in cut(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((i if i is not None else -1, held(i), len(cut(t)), sum(counts[w] > 0 for w in cut(t)), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in cut(t)), 4)) for i, t in rows)
    got = lm_scores.lm_scores(docs, hot_most=hot).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    ordinary = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 1000 and r["n_bytes"] > 400]
    assert all(r["score"] < 0 for r in got)
    assert np.mean([r["bits_per_byte"] for r in ordinary if r["held_out"]]) < 4


def test_lm_is_a_distribution():
    """Costs of all 256 next bytes of a context add up to a probability of one."""
    rng = np.random.default_rng(1)
    table = rng.integers(0, 40, (1 << lm_scores.SLOT_BITS, 2)).astype(np.float16)
    model = lm_scores.Mixer(table)
    model.observe(rng.integers(0, 1 << 48, 500).astype(np.uint64), np.ones(500))
    model.settle()
    for context in rng.integers(0, 1 << 40, 5):
        window = (np.uint64(context) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert (2.0 ** -model.cost(window)).sum() == pytest.approx(1, abs=1e-3)


def test_lm_cost_is_the_definition():
    """Bits of single windows, mixed and refined by plain arithmetic."""
    rng = np.random.default_rng(4)
    model = lm_scores.Mixer(rng.integers(0, 30, (1 << lm_scores.SLOT_BITS, 2)).astype(np.float16))
    model.weights = rng.normal(0.2, 0.1, model.weights.shape)
    model.observe(rng.integers(0, 1 << 48, 300).astype(np.uint64), np.ones(300))
    model.settle()
    low, limit = np.linspace(-lm_scores.MAP_LIMIT, lm_scores.MAP_LIMIT, lm_scores.MAP_STEPS + 1), lm_scores.MAP_LIMIT
    for window in rng.integers(0, 1 << 48, 12).tolist():
        bits, last = 0.0, window & 255
        for bit in range(8):
            node, value = last >> (8 - bit) | 1 << bit, last >> (7 - bit) & 1
            x, seen = [], 0
            for order in range(lm_scores.ORDER + 1):
                context = (window >> 8) & ((1 << 8 * order) - 1)
                key = np.array([((context << 8 | node) * 0x9E3779B97F4A7C15 + order + 1) % (1 << 64)], np.uint64)
                zeros, ones = (float(c) for c in model.table[int(mix(key)[0]) >> (64 - lm_scores.SLOT_BITS)])
                x.append(math.log((ones + lm_scores.PRIOR) / (zeros + lm_scores.PRIOR)))
                seen += zeros + ones > 0
            mixed = min(limit, max(-limit, sum(w * v for w, v in zip(model.weights[bit, seen], [*x, 0.3], strict=True))))
            k = min(lm_scores.MAP_STEPS - 1, int((mixed + limit) * lm_scores.MAP_STEPS / (2 * limit)))
            part = (mixed - low[k]) / (low[1] - low[0])
            p = 0.5 / (1 + math.exp(-mixed)) + 0.5 * ((1 - part) * model.refined[node, k] + part * model.refined[node, k + 1])
            bits -= math.log2(p if value else 1 - p)
        assert model.cost(np.array([window], np.uint64))[0] == pytest.approx(bits, rel=1e-4)


def test_lm_scores_do_not_depend_on_tasks(spark, tiny_docs):
    docs = tiny_docs.select("doc_id", "text").limit(60).cache()
    first, second = ({r["doc_id"]: r["score"] for r in lm_scores.lm_scores(docs.repartition(n)).collect()} for n in (1, 6))
    assert set(first) == set(second) and all(abs(first[k] - second[k]) < 0.02 * abs(first[k]) + 1 for k in first)


def test_lm_without_rows(spark, none):
    assert lm_scores.lm_scores(none).count() == 0


# -- 7 -----------------------------------------------------------------------------------------
def test_license_scan(spark, odd, none):
    apache = next(t for n, t in license_scan.TEMPLATES if n == "Apache-2.0" and len(t) > 200)
    rows = [
        (1, "prose before the license\nReleased under the MIT License.\nand prose after of the thing"),
        (2, "Licensed under the Apache License, Version 2.0. " * 2),
        (3, "x y z " * 50 + apache.replace("software", "code").replace(",", "") + " the of and" * 30),
        (4, "the license of the work under version two"),
        (5, "THIS WORK is licensed under the gnu general public license version 3"),
    ]
    got = {r["doc_id"]: r for r in license_scan.license_scan(docs_of(spark, rows)).collect()}
    assert got[1]["license"] == "MIT" and got[1]["coverage"] == 1.0 and [(s["first_word"], s["last_word"]) for s in got[1]["spans"]] == [(4, 8)]
    assert got[2]["license"] == "Apache-2.0" and got[2]["n_found"] == 2
    assert got[3]["license"] == "Apache-2.0" and got[3]["coverage"] > 0.9
    assert got[4]["license"] is None
    assert got[5]["license"] == "GPL-3.0" and got[5]["coverage"] == 1.0
    assert license_scan.license_scan(odd).filter("license is null").count() == odd.count()
    assert license_scan.license_scan(none).count() == 0


def test_license_scan_past_stray_pairs(spark):
    apache = next(t for n, t in license_scan.TEMPLATES if n == "Apache-2.0" and len(t) > 200)
    isc = next(t for n, t in license_scan.TEMPLATES if n == "ISC").split()
    rows = [
        (1, apache.replace("software distributed", "all or part of the software distributed")),
        (2, " ".join(w if k % 7 == 0 else f"{w} extra{k}" for k, w in enumerate(isc))),
        (3, "x y z " + apache.replace("software distributed", "all or part of the software distributed") + " of the " + apache),
    ]
    got = {r["doc_id"]: r for r in license_scan.license_scan(docs_of(spark, rows)).collect()}
    assert got[1]["license"] == "Apache-2.0" and got[1]["coverage"] == 1.0
    assert got[2]["license"] == "ISC" and got[2]["coverage"] > 0.9
    assert [s["coverage"] > 0.95 for s in got[3]["spans"] if s["last_word"] - s["first_word"] > 40] == [True, True]


def test_license_scan_is_sound_and_complete(spark):
    """Templates with words changed, dropped and added: what is found covers enough by any alignment, and what is left whole enough is found."""
    rng = np.random.default_rng(13)
    words = lambda t: re.findall(r"[0-9a-z]+", t.lower())
    templates = [(n, words(t)) for n, t in license_scan.TEMPLATES]
    rows, share = [(500, "of the work under the license to " * 300 + " ".join(templates[-1][1])), (501, ""), (502, None)], {}
    for k in range(80):
        name, own = templates[k % len(templates)]
        drop = rng.random(len(own)) < rng.choice([0.0, 0.05, 0.15, 0.4, 0.7])
        out = []
        for w, gone in zip(own, drop, strict=True):
            out += ["changed"] * int(rng.random() < 0.1) + ([] if gone else [w])
        share[k] = (name, 1 - drop.mean())
        rows.append((k, " ".join(["some", "prose"] * int(rng.integers(0, 30)) + out + ["the", "end"] * int(rng.integers(0, 30)))))
    got = {r["doc_id"]: r for r in license_scan.license_scan(docs_of(spark, rows)).collect()}
    for k, text in rows:
        if got[k]["license"]:
            best = max(len(license_scan.common(words(text), t)) / len(t) for n, t in templates if n == got[k]["license"])
            assert license_scan.COVERAGE <= got[k]["coverage"] <= best + 1e-9
        if k in share and share[k][1] == 1.0:
            assert got[k]["license"] and share[k][0] in got[k]["licenses"]
        if k in share and share[k][1] < 0.5 and len(templates[k % len(templates)][1]) > 30:
            assert share[k][0] not in got[k]["licenses"] or len(templates[k % len(templates)][1]) < 30 or any(n == share[k][0] and len(t) < 30 for n, t in templates)
    assert got[500]["license"] == license_scan.TEMPLATES[-1][0] and got[501]["coverage"] == got[502]["coverage"] == 0


def test_patience_is_a_common_subsequence():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = (rng.integers(0, 9, rng.integers(0, 15)).tolist() for _ in range(2))
        pairs = license_scan.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
        best = license_scan.common(a, b)
        assert len(pairs) <= len(best)
    assert len(license_scan.patience([1, 2, 3, 4], [0, 1, 9, 3, 4])) == 3


# -- 9 -----------------------------------------------------------------------------------------
def brute_similarity(a, b):
    words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
    s, t = ([tuple(w[k : k + 5]) for k in range(len(w) - 4)] for w in (words(a), words(b)))
    row = [0] * (len(t) + 1)
    for x in s:
        new = [0]
        for j, y in enumerate(t):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1] / (len(s) + len(t) - row[-1]) if s and t else 0.0


def test_near_classes(spark):
    rng = np.random.default_rng(7)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(400)]
    rows = []
    for base in range(12):
        words = rng.choice(vocabulary, 150).tolist()
        for copy in range(int(rng.integers(1, 6))):
            own = list(words)
            for k in rng.integers(0, 150, int(rng.integers(0, 7))):
                own[k] = rng.choice(vocabulary)
            text = " ".join(own)
            rows.append((len(rows), text.upper() + "!" if copy == 2 else text))
    rows += [(len(rows) + k, rows[0][1]) for k in range(4)] + [(900, None), (901, ""), (902, "?!"), (903, "short text"), (904, "Short, text."), (None, "short text")]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_dedup(docs_of(spark, rows)).collect()}
    texts_ = [(i, t or "") for i, t in rows if i is not None and i < 900]
    parent = {i: i for i, _ in texts_}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(texts_):
        for j, b in texts_[:k]:
            if a.lower().strip("!") == b.lower().strip("!") or brute_similarity(a, b) >= 0.8:
                lo, hi = sorted((root(i), root(j)))
                parent[hi] = lo
    assert {i: got[i] for i in parent} == {i: root(i) for i in parent}
    assert got[900] == got[901] == 900 and got[902] == 902
    assert got[903] is None and got[904] is None  # the class has a row without an id, which is least
    kept = near_dedup.deduplicated(docs_of(spark, rows)).collect()
    assert len(kept) == len(set(got.values()))


def test_similarity_is_the_full_alignment():
    rng = np.random.default_rng(4)
    met = 0
    for _ in range(200):
        a = rng.integers(0, 40, rng.integers(5, 60)).astype(np.uint64)
        b = a.copy()
        for k in rng.integers(0, len(b), rng.integers(0, 4)):
            k = min(k, len(b) - 1)
            b = np.insert(np.delete(b, k), k, rng.integers(0, 40, rng.integers(0, 3)).astype(np.uint64))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        full = row[-1] / (len(a) + len(b) - row[-1])
        got = near_dedup.similarity(a, b)
        met += full >= 0.8
        assert got == pytest.approx(full) if full >= 0.8 else got < 0.8, (a, b, got, full)
    assert met > 30


def test_near_keys_of_texts_of_mixed_length():
    """Share of pairs of similarity 0.8 to 0.85 that have a key in common; counts lie on both sides of powers of two."""
    rng = np.random.default_rng(12)
    met = pairs = 0
    for n in (30, 62, 66, 128, 250, 256, 512, 700, 1024, 1030, 2048):
        for _ in range(60):
            a = rng.integers(0, 1 << 60, n).astype(np.uint64)
            cut = int(n * rng.uniform(0.02, 0.19))
            at = int(rng.integers(0, n - cut))
            b = np.concatenate([a[:at], a[at + cut :]]) if rng.random() < 0.6 else np.concatenate([a[:at], rng.integers(0, 1 << 60, cut // 3).astype(np.uint64), a[at + cut // 3 :]])
            s, t = near_dedup.shingles(a), near_dedup.shingles(b)
            if near_dedup.similarity(s, t) >= 0.8:
                pairs += 1
                met += bool((near_dedup.order_minhash(s, near_dedup.SKETCHES) == near_dedup.order_minhash(t, near_dedup.SKETCHES)).any())
    assert pairs > 300 and met / pairs >= 0.98


def test_alignment_costs_its_band():
    """Long texts: equal starts and ends, and a band of matches between."""
    rng = np.random.default_rng(6)
    a = rng.integers(0, 1 << 60, 40_000).astype(np.uint64)
    b = np.where(rng.random(len(a)) < 0.05, a + np.uint64(1), a)
    same = int((a == b).sum())
    assert near_dedup.similarity(a, b) == pytest.approx(same / (2 * len(a) - same))


def test_near_dedup_with_names_of_its_own(spark):
    rows = [(1, "one text of some few words here"), (2, "one text of some few words here"), (3, "other words that none has yet")]
    docs = docs_of(spark, rows).withColumns({c: F.lit(c) for c in ("kept_id", "kept_sig", "kept_high", "kept_low", "kept_id_", "own_id", "same", "node", "data", "high", "low")})
    got = near_dedup.deduplicated(docs)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == [1, 3]
    assert {r["kept_high"] for r in got.collect()} == {"kept_high"}
    assert line_dedup.cleaned(docs).columns == docs.columns and line_dedup.cleaned(docs).count() == 3


def test_near_dedup_of_odd_rows(spark, odd, none):
    assert near_dedup.near_dedup(odd).count() == odd.count()
    assert near_dedup.near_dedup(none).count() == near_dedup.deduplicated(none).count() == 0
    assert near_dedup.deduplicated(odd).columns == odd.columns


def test_near_dedup_of_a_hot_group(spark):
    rows = [(k, "the same words in every copy of this text here") for k in range(300)] + [(1000 + k, f"w{k} " + " ".join(f"v{k}q{i}" for i in range(20))) for k in range(20)]
    got = near_dedup.near_dedup(docs_of(spark, rows)).collect()
    assert sum(r["kept"] for r in got) == 21


def test_near_pairs_in_hot_buckets(spark):
    """Pairs whose texts are mostly one passage that many others have too, whom they are not similar to."""
    rng = np.random.default_rng(11)
    passage = [f"common{k}" for k in range(170)]
    rows = []
    for pair in range(40):
        own = [f"own{pair}x{k}" for k in range(30)]
        rows.append((2 * pair, " ".join(passage + own)))
        for k in (7, 15, 23):
            own[k] = f"changed{pair}x{int(rng.integers(0, 99))}y{k}"
        rows.append((2 * pair + 1, " ".join(passage + own)))
    assert brute_similarity(rows[0][1], rows[1][1]) >= 0.8 > brute_similarity(rows[0][1], rows[2][1])
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_dedup(docs_of(spark, rows)).collect()}
    assert got == {k: k - k % 2 for k in range(80)}


# -- 10 ----------------------------------------------------------------------------------------
def test_quality(spark, odd, none):
    rng = np.random.default_rng(9)
    good, bad = ["stone", "river", "lamp", "tree", "cloud"], ["BUY!!", "$$$", "click***", "WIN!!", "now%%%"]
    rows = [(k, " ".join(rng.choice(good if k % 2 else bad + good[:1], 40))) for k in range(300)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)] + [(None, 1), (5000, 0), (7, None)], "doc_id long, quality int")
    docs = docs_of(spark, rows).unionByName(odd)
    got = quality.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and 60 < r["doc_id"] < 300]
    assert len(held) > 20 and np.mean([r["predicted"] == r["doc_id"] % 2 for r in held]) > 0.95
    assert quality.accepted(docs, labels).columns == docs.columns
    assert quality.classify(none, labels).count() == 0
    assert {r["score"] for r in quality.classify(odd, labels.limit(0)).collect()} == {0.5}


def test_machine_counts_every_pair():
    """The sum-of-squares identity equals the sum over all pairs of features."""
    rng = np.random.default_rng(0)
    m = quality.Machine()
    index, value = rng.choice(quality.WIDTH, 9, replace=False), rng.normal(size=9)
    m.linear[index] = rng.normal(size=9)
    want = m.bias + (m.linear[index] * value).sum() + sum(m.factors[index[a]] @ m.factors[index[b]] * value[a] * value[b] for a in range(9) for b in range(a))
    assert m.margins(np.array([0, 9]), index, value)[0][0] == pytest.approx(want)
