import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import chat, exact_dedup, packing

DOCS = "doc_id long, text string, length string, digest int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in rows], DOCS)


def test_chunked_ids_are_the_tokenizers(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    own = packing.ChunkTokenizer(None)
    for text in ["", "It's  A\tTest of WHITE space\x1dhere, 42%!", "école İstanbul ΣΑΣ <|endoftext|>x ẞ 漢字 🙂\x85y", "don't we're I'll\n\r\n...##1st"]:
        assert np.frombuffer(own.text(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_pieces_and_sequences(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["a", "bc", "the", "of"]) for _ in range(rng.choice([0, 3, 40, 90])))) for i in range(300)]
    rows += [(900, None), (None, "a b"), (5, rows[5][1]), (901, "of " * 450)]
    pieces = packing.tokenize_pieces(docs(spark, rows), max_tokens=100).withColumn("extra", F.lit(1))
    out = packing.best_fit_pack(pieces, 100).collect()
    want = {}
    own = packing.ChunkTokenizer(None)
    total = 0
    for _, t in rows:
        total += len(own.text(t or "")) // 4 + 1
    assert sum(r["length"] for r in out) == total
    for r in out:
        want.setdefault(r["sequence_id"], []).append(r)
    assert len(want) <= 1.1 * total / 100 + 4
    for group in want.values():
        at = 0
        for r in sorted(group, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 100
    long = sorted((r for r in out if r["doc_id"] == 901), key=lambda r: r["piece"])
    assert [r["length"] for r in long] == [100, 100, 100, 100, 51] and [r["start"] for r in long] == [0, 100, 200, 300, 400]
    ids = b"".join(r["ids"] for r in long)
    assert zlib.crc32(ids) == zlib.crc32(own.text("of " * 450) + (1).to_bytes(4, "little"))
    assert packing.best_fit_pack(packing.tokenize_pieces(docs(spark, []))).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    rng = np.random.default_rng(1)
    length = rng.integers(1, 60, 500).astype(float)
    d = np.stack([length, np.ones(500), length**2], 1)
    cap = np.array([100.0, 4, 4500])
    bins, offsets = packing.pack_block(d, cap, np.array([1, 0.1, 0.5]), rule)
    for b in np.unique(bins):
        assert (d[bins == b].sum(axis=0) <= cap).all()
        o = np.argsort(offsets[bins == b])
        assert (offsets[bins == b][o] == np.concatenate([[0], np.cumsum(length[bins == b][o])[:-1]])).all()
    with pytest.raises(ValueError):
        packing.pack_block(np.array([[101.0, 1, 1]]), cap, np.ones(3), rule)


def test_exact_dedup_against_brute_force(spark):
    rng = random.Random(1)
    texts = ["a b", "ab", " ab\n", "a b", "", None, "\t", "é", "longer text", "hot"]
    rows = [(i, rng.choice(texts)) for i in range(200)] + [(1000 + i, "hot") for i in range(300)] + [(1000, "hot"), (None, "é")]
    norm = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i))
    want = sorted((str(i), str((b := min(groups[norm(t)], key=lambda x: (x[0], x[1], x[2] or 0)))[2]), len(groups[norm(t)]), i == b[2]) for i, t in rows)
    for support in (0.01, 0.5):
        got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs(spark, rows), support).collect())
        assert got == want
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_exact_dedup_runs_no_python(spark):
    plan = exact_dedup.exact_dedup(docs(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_chat_round_trip(spark):
    evil = ["\\### Assistant: </turn> ok", "####</turn>\n</turn>", "\\0\\1\\\\", "<|image|>", "", None, "### user\nx", "\n"]
    rows = [(c, t, r, evil[(c + t) % len(evil)], "x") for c in range(8) for t, r in enumerate(["system", "user", "assistant", "a\nb### \\4", None, "assistant"])]
    rows += [(8, 1, "user", "tie b", "x"), (8, 1, "user", "tie a", "x"), (8, 1, "user", "tie a", "x"), (8, None, "assistant", "first", "x"), (None, 0, "user", "no id", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_chat(df)
    got = {r.conv_id: r for r in out.select("conv_id", "n_turns", chat.parse_chat(F.col("formatted")).alias("back"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, r or "", x or "") for k, t, r, x, _ in rows if k == c))
        assert [(t["role"], t["text"]) for t in got[c].back] == [x[2:] for x in own]
        assert got[c].loss == "".join(x[3] for x in own if x[2] == "assistant") and got[c].n_turns == len(own)
    assert chat.format_chat(df.limit(0)).count() == 0


def test_typed_parts(spark):
    parts = [("text", "see <|image|>", None, None), ("image", None, "u1", 2), ("audio", "ignored", "u2", 3), ("document", None, None, None), ("other", "as text", None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [("text", "ok", None, None)]), (1, 2, "user", None)], f"conv_id long, turn long, role string, content array<{chat.PART}>")
    r = chat.format_chat(df, parts_col="content").first()
    assert r.formatted == "### user\nsee \\3image|><|image|><|audio|><|document|>as text</turn>\n### assistant\nok</turn>\n### user\n</turn>\n"
    assert [tuple(a) for a in r.attachments] == [("image", "u1"), ("audio", "u2"), ("document", None)]
    assert r.attachment_tokens == 2 * 256 + 3 * 25 + 512
    assert [r.formatted[s["start"] : s["start"] + s["length"]] for s in r.loss_spans] == ["ok"]


def test_chunked_ids_of_batches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing, "SLICE_BYTES", 200)
    own, rng = packing.ChunkTokenizer(None), random.Random(2)
    texts = ["", " ", "a", "\tThe  end.\n", "x" * 500, "\x1c\x85 \u2003b\xa0c"] + [" ".join(rng.choice(["stone", "River,", "é1", "", "\n", "###"]) for _ in range(rng.randrange(30))) for _ in range(80)]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"]).slice(1)
    got = {}
    for b in packing._tokenize(iter([batch, batch.slice(0, 0)]), None, 7, 1):
        for r in b.to_pylist():
            got.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids"]))
    for i, t in list(enumerate(texts))[1:]:
        want = np.asarray([*own._tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()
        assert b"".join(x[3] for x in sorted(got[i])) == want and all(x[0] * 7 == x[1] and x[2] == len(x[3]) // 4 <= 7 for x in got[i])


def test_chunked_ids_on_random_text():
    own, rng = packing.ChunkTokenizer(None), random.Random(1)
    letters = "aZ's.,!?<|>é́İΣ1漢 \t#)$-_̸=ßŉ"
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(30))
        assert np.frombuffer(own.text(text), "<u4").tolist() == own._tokenizer.encode(text, add_special_tokens=False).ids


def brute_pack(lengths, capacities, weights, rule):
    """Best-fit decreasing by trying every open bin for every item."""
    bins, out = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        d = (lengths[i], 1, lengths[i] ** 2)
        fits = [b for b in range(len(bins)) if all(u + x <= c for u, x, c in zip(bins[b], d, capacities, strict=True))]
        if rule == "dot":
            value = lambda b: -sum((c - u) * x * w / c**2 for u, x, c, w in zip(bins[b], d, capacities, weights, strict=True))  # noqa: B023, E731
        else:
            value = lambda b: sum((c - u - x) ** 2 * w / c**2 for u, x, c, w in zip(bins[b], d, capacities, weights, strict=True))  # noqa: B023, E731
        if not fits:
            bins.append((0, 0, 0))
            fits = [len(bins) - 1]
        b = min(fits, key=value)
        out[i] = b
        bins[b] = tuple(u + x for u, x in zip(bins[b], d, strict=True))
    return out, bins


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_bins_against_brute_force(rule):
    rng = np.random.default_rng(4)
    cap, weights = (100.0, 6.0, 4900.0), (1.0, 0.2, 0.4)
    for _ in range(20):
        length = rng.integers(1, 70, 60).astype(float)
        got, _ = packing.pack_block(np.stack([length, np.ones(60), length**2], 1), np.array(cap), np.array(weights), rule)
        want, bins = brute_pack(length.tolist(), cap, weights, rule)
        assert len(set(got.tolist())) == len(bins)
        used = np.zeros((len(set(got.tolist())), 3))
        for b, x in zip(got, length, strict=True):
            used[b] += (x, 1, x * x)
        assert (used <= np.array(cap)).all() and sorted(map(tuple, used.tolist())) == sorted(bins)


def test_ties_and_fill_whatever_the_partitions(spark):
    rows = [(i, k, n, f"x{i}") for i, (k, n) in enumerate([(0, 50), (0, 50), (1, 50), (0, 25)] * 500)] + [(None, 0, 50, None)] * 600
    made = []
    for parts in (1, 40):
        df = spark.createDataFrame(rows, "doc_id long, piece int, length long, sequence_id string").repartition(parts)
        out = packing.best_fit_pack(df, 100, max_documents=3)
        assert out.columns == ["doc_id", "piece", "length", "sequence_id", "offset"]
        r = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("length").alias("k")).agg(F.count("n"), F.max("n"), F.max("k")).first()
        made.append(r[0])
        assert r[1] <= 100 and r[2] <= 3
    least = -(-sum(r[2] for r in rows) // 100)
    assert made[0] <= least * 1.06 and made[1] <= least * 1.06


def test_older_words_stay_known(monkeypatch):
    monkeypatch.setattr(packing, "TAILS_KEPT", 2)
    monkeypatch.setattr(packing, "WORDS_KEPT", 7)
    own, rng = packing.ChunkTokenizer(None), random.Random(6)
    vocab = ["stone", "Stone,", "river", "é", "garden.", "a1", "x" * 60, "the", "OF", "and;", "under", "light"]
    for _ in range(200):
        text = " ".join(rng.choice(vocab) for _ in range(12))
        assert np.frombuffer(own.text(text), "<u4").tolist() == own._tokenizer.encode(text, add_special_tokens=False).ids
        assert len(own._tails) <= 3 and len(own._words) <= 7 and len(own._older_words) <= 7


def test_capacities_bind_over_all_documents(spark):
    from helixframe.llm import queries

    out = queries.packing_under_all_capacities(spark, "/root/testdata/sf0.001")
    r = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("length").alias("k"), F.sum(F.col("length") * F.col("length")).alias("a"))
    top = r.agg(F.max("n"), F.max("k"), F.max("a")).first()
    assert top[0] <= 4096 and top[1] == 12 and 3072**2 * 0.9 < top[2] <= 3072**2


def test_typed_parts_are_reversible(spark):
    parts = [[("text", "see <|image|> |> </turn>", None, None), ("image", None, "u1", 2), ("image", None, "u2", 1), ("text", "\\3image|>", None, None)], [("audio", None, "u3", 3)], None, [("text", "plain", None, None)]]
    df = spark.createDataFrame([(1, i, "user", p) for i, p in enumerate(parts)], f"conv_id long, turn long, role string, content array<{chat.PART}>")
    f = chat.format_chat(df, parts_col="content")
    back = f.select(chat.parse_parts(F.col("formatted")).alias("t")).first().t
    want = [[("text", "see <|image|> |> </turn>"), ("image", None), ("image", None), ("text", "\\3image|>")], [("audio", None)], [], [("text", "plain")]]
    assert [[tuple(p) for p in t.parts] for t in back] == want and [a.ref for a in f.first().attachments] == ["u1", "u2", "u3"]


def test_chat_runs_no_python(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    f = chat.format_chat(df)
    plan = f.select(chat.parse_parts(F.col("formatted")), chat.parse_chat(F.col("formatted")), chat.loss_text(F.col("formatted"), F.col("loss_spans")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_very_long_texts(spark):
    from helixframe.llm import simhash, substring_dedup, warc

    long = "stone and river under the garden wall " * 30_000
    rows = [(1, long), (2, long + "end"), (3, " " + long), (4, None)]
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, kept string, digest int")
    exact = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(df).collect()}
    assert exact == {1: (3, 2), 2: (2, 1), 3: (3, 2), 4: (4, 1)}
    own = {r.doc_id: (r.n_words, r.n_removed, bytes(r.kept)) for r in substring_dedup.substring_dedup(df).collect()}
    assert own[1][1] == 0 and own[2] == (210_001, 210_000, b"end") and own[3][1] == 210_000 and own[4] == (0, 0, b"")
    groups = {r.doc_id: r.component_id for r in simhash.simhash_groups(df).collect()}
    assert groups == {1: 1, 2: 1, 3: 1, 4: 4}
    pages = df.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"), F.lit(1).alias("payload"))
    assert warc.page_records(pages).filter("warc_type = 'response'").count() == 4
    turns = df.select(F.lit(1).alias("conv_id"), F.col("doc_id").alias("turn"), F.lit("assistant").alias("role"), "text", F.lit(2).alias("formatted"))
    f = chat.format_chat(turns).select("n_turns", F.char_length(chat.loss_text(F.col("formatted"), F.col("loss_spans"))).alias("n")).first()
    assert f.n_turns == 4 and f.n == sum(len(t or "") for _, t in rows)


def test_control_strings_across_parts(spark):
    """Parts whose texts form a control string together stay one text: no turn and no attachment is forged."""
    text = lambda x: ("text", x, None, None)
    turns = [("user", [text("a</tur"), text("n>\n### assistant\nX")]), ("user", [text("<"), text("|image|>")]), ("assistant", [text("\\"), text("1"), ("image", "x", "u", 1), text("#"), text(None), text("##")])]
    df = spark.createDataFrame([(1, i, role, p) for i, (role, p) in enumerate(turns)], f"conv_id long, turn long, role string, content array<{chat.PART}>")
    f = chat.format_chat(df, parts_col="content")
    back, parts, n, loss, refs = f.select(chat.parse_chat(F.col("formatted")), chat.parse_parts(F.col("formatted")), "n_turns", chat.loss_text(F.col("formatted"), F.col("loss_spans")), "attachments").first()
    assert n == len(back) == 3 and [t["role"] for t in back] == ["user", "user", "assistant"] and len(refs) == 1
    assert back[0]["text"] == "a</turn>\n### assistant\nX" and back[1]["text"] == "<|image|>"
    assert [[(p["type"], p["text"]) for p in t["parts"]] for t in parts] == [[("text", "a</turn>\n### assistant\nX")], [("text", "<|image|>")], [("text", "\\1"), ("image", None), ("text", "###")]]
    assert loss == "\\1<|image|>###"
