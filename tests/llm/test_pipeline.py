"""The corpus pipeline: stages chain, keep the columns of documents, and take effect."""

import corpus_pipeline
from codexa.llm import registry


def test_stages(spark, tiny, tmp_path):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "packing"]
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / str(k))
        stage(spark, docs, tiny).write.parquet(out)
        docs = spark.read.parquet(out)
        if name != "packing":
            assert docs.columns == columns
            assert 0 < docs.count() < before if name != "line_dedup" else docs.count() <= before
            before = docs.count()
    assert docs.select("doc_id").distinct().count() == before


def test_queries_are_named():
    names = [*registry.queries()]
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)]
    assert set(registry.oracles()) <= set(names)


def test_stages_are_their_definitions(spark, tmp_path):
    """Each stage on a small table against brute force; nulls, repeated rows, empty texts and clashing columns included."""
    import re
    import zlib

    import numpy as np
    from pyspark.sql import functions as F

    from codexa.llm import quality
    from tests.llm.test_llm_operators import brute_line_dedup, brute_similarity

    rng = np.random.default_rng(21)
    good, bad = ["stone", "river", "lamp", "tree", "cloud", "field"], ["BUY!!", "$$$", "click***", "WIN!!", "now%%%"]
    passage = " ".join(f"passage{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(55))
    rows = []
    for k in range(120):
        base = good if k % 3 else bad
        text = " ".join(f"{w}{chr(97 + int(rng.integers(0, 26)))}" if base is good else w for w in rng.choice(base, 40))
        rows.append((k, text + ("\n" + passage if k in (4, 7, 50) else "")))
    rows += [(200, rows[1][1]), (201, rows[2][1].replace("a", "b", 1)), (202, None), (203, ""), (None, rows[5][1]), (4, rows[4][1])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    docs = docs.withColumns({c: F.lit("x") for c in ("score", "numbers", "same", "kept_id", "high", "row", "key")})
    spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    pairs = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["quality"](spark, docs, str(tmp_path)).cache()
    told = quality.classify(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).filter("predicted = 1")
    assert sorted(r["doc_id"] is not None and r["doc_id"] for r in told.collect()) == sorted(r["doc_id"] is not None and r["doc_id"] for r in kept.collect())
    assert kept.columns == docs.columns and 40 < kept.count() < len(rows)

    own = pairs(kept)
    gone = brute_line_dedup([(-(1 << 63) if i is None else i, t) for i, t in own])
    want = []
    for i, t in own:
        lost = gone[-(1 << 63) if i is None else i, t or ""]
        text = "\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in lost) if lost else t
        if not lost or text.strip():
            want.append((i, text))
    lined = stages["line_dedup"](spark, kept, str(tmp_path)).cache()
    assert pairs(lined) == sorted(want, key=repr)
    assert all(r["n_chars"] == len(r["text"] or "") for r in lined.collect())

    own = pairs(lined)
    plain = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    parent = list(range(len(own)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(own)):
        for b in range(a):
            x, y = own[a][1] or "", own[b][1] or ""
            if (plain(x) == plain(y) if plain(x) or plain(y) else x == y) or brute_similarity(x, y) >= 0.8:
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(own):
        least[root(k)] = min(least.get(root(k), (True, 1 << 62)), (i is not None, i or 0))
    single = stages["near_dedup"](spark, lined, str(tmp_path)).cache()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in single.collect()) == sorted(least.values())

    import public_tokenizers
    import tokenizers

    lib = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed, bins = stages["packing"](spark, single, str(tmp_path)).collect(), {}
    ids = {i: [*lib.encode(t or "", add_special_tokens=False).ids, 0] for i, t in pairs(single)}
    for r in packed:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(n for own in bins.values() for _, n in own) == sum(map(len, ids.values()))
    for own in bins.values():
        own.sort()
        assert own[0][0] == 0 and sum(own[-1]) <= 2048 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False))


def test_stages_of_an_empty_table(spark, tiny, tmp_path):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, tiny).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.count() == 0
