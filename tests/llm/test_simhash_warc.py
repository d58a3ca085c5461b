import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from helixframe.llm import components, simhash, warc


def brute_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_fingerprints_and_groups_against_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}É" for i in range(50)] + ["The", "of"]
    base = [[rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 5, 700, 900]))] for _ in range(25)]
    rows = [(0, None), (1, ""), (2, " \n "), (3, "A b")]
    for i in range(160):
        w = list(rng.choice(base))
        if len(w) > 100 and rng.random() < 0.7:
            w[rng.randrange(len(w))] = "changed"
        rows.append((10 + i, " ".join(w)))
    rows += [(12, rows[6][1]), (None, "A b")]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, fp long")
    got = simhash.simhash_groups(df).collect()
    prints = [(i, brute_fingerprint(t or "")) for i, t in rows]
    assert sorted((str(r.doc_id), r.fp & (2**64 - 1)) for r in got) == sorted((str(i), f) for i, f in prints)
    ids = {}
    for i, f in prints:
        ids.setdefault(f, []).append(i)
    group = {f: f for f in ids}
    for _ in ids:
        for x in ids:
            for y in ids:
                if (x ^ y).bit_count() <= 3:
                    group[x] = group[y] = min(group[x], group[y])
    least = {}
    for f, own in ids.items():
        least[group[f]] = min([i for i in own if i is not None] + [least.get(group[f], 10**9)])
    for r in got:
        assert r.component_id == least[group[r.fp & (2**64 - 1)]]
    assert any(r.component_id != r.doc_id for r in got)
    assert simhash.simhash_groups(df.limit(0)).count() == 0


def test_bit_sliced_links_connect_what_pairs_connect():
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 2**63, 6).astype(np.uint64)
    values = np.array([centres[rng.integers(6)] ^ sum((np.uint64(1) << np.uint64(b) for b in rng.choice(64, rng.integers(0, 5), False)), np.uint64(0)) for _ in range(900)], np.uint64)
    keys = np.sort(np.concatenate([np.zeros(600, int), rng.integers(1, 150, 300)]))
    a, b = simhash.bucket_links(keys, values)
    assert all((int(x) ^ int(y)).bit_count() <= 3 for x, y in zip(a, b, strict=True))

    def parts(pairs):
        root = {}
        find = lambda i: i if root.setdefault(i, i) == i else find(root[i])
        for x, y in pairs:
            root[find(x)] = find(y)
        return {frozenset(j for j in root if find(j) == r) for r in {find(i) for i in root}}

    for k in (0, 7):
        own = [int(v) for v in values[keys == k]]
        want = parts((x, y) for x in own for y in own if x < y and (x ^ y).bit_count() <= 3)
        have = parts((int(x), int(y)) for x, y in zip(*simhash.bucket_links(np.zeros(len(own), int), np.array(own, np.uint64)), strict=True) if x != y)
        assert want == have


def test_close_pairs_spread_over_buckets(spark):
    a = 0x0123456789ABCDEF
    values = [a, a ^ 1 ^ 1 << 20 ^ 1 << 50, a ^ 15, -5, -5 ^ (1 << 62)]
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {frozenset((r.a, r.b)) for r in simhash.close_pairs(df).collect()}
    assert got == {frozenset(values[:2]), frozenset(values[3:])}


def brute_parts(values, radius=3):
    values, root = list(map(int, values)), {}
    find = lambda i: i if root.setdefault(i, i) == i else find(root[i])
    for i, x in enumerate(values):
        find(x)
        for y in values[:i]:
            if ((x ^ y) & (2**64 - 1)).bit_count() <= radius:
                root[find(x)] = find(y)
    return {frozenset(j for j in values if find(j) == r) for r in {find(i) for i in values}}


def test_dense_buckets_meet_between_their_values(spark):
    rng = np.random.default_rng(3)
    centres = [int(c) for c in rng.integers(0, 2**62, 3)]
    values = sorted({c ^ sum(1 << int(b) for b in rng.choice(24, rng.integers(0, 6), False)) for c in centres for _ in range(60)})
    df = spark.createDataFrame([(v,) for v in values], "fp long").repartition(3)
    want = brute_parts(values)
    for crowd, dense in ((256, 4096), (256, 8), (2, 4096)):
        links = [(r.a, r.b) for r in simhash.close_pairs(df, crowd=crowd, dense=dense).collect()]
        assert all((a ^ b).bit_count() <= 3 for a, b in links)
        root = {v: v for v in values}
        find = lambda i: i if root[i] == i else find(root[i])  # noqa: E731, B023
        for a, b in links:
            root[find(a)] = find(b)
        assert {frozenset(j for j in values if find(j) == r) for r in {find(i) for i in values}} == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 150)] + [(5, 5), (None, 3), (30, 20), (30, 20)]
    got = dict(tuple(r) for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in [*range(21), 30]} | {i: 100 for i in range(100, 150)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def pages(spark):
    rows = [(5, "http://a\r\nX: y", "same"), (3, None, "same"), (9, "u", None), (7, "u", ""), (1, "u", "é\r\n\r\nWARC/1.1\r\n"), (None, "u", "same"), (3, "again", "same")]
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int")


def test_warc_round_trip(spark, tmp_path):
    warc.register(spark)
    for n, compress in enumerate(["false", "true"]):
        path = f"file://{tmp_path}/w{n}"
        warc.page_records(pages(spark)).write.format("warc").mode("append").option("path", path).option("compress", compress).save()
        (tmp_path / f"w{n}" / "stray.warc").write_bytes(b"cut off")
        back = spark.read.format("warc").option("verify", "true").load(path)
        got = {(r.record_id, r.warc_type, r.refers_to, r.payload_length, r.payload and bytes(r.payload)) for r in back.collect()}
        assert got == {
            ("<urn:page:5>", "revisit", "<urn:page:3>", 4, None), ("<urn:page:3>", "response", None, 4, b"same"), ("<urn:page:9>", "revisit", "<urn:page:7>", 0, None),
            ("<urn:page:7>", "response", None, 0, b""), ("<urn:page:1>", "response", None, 16, "é\r\n\r\nWARC/1.1\r\n".encode()), ("<urn:page:null>", "revisit", "<urn:page:3>", 4, None),
        }
        assert back.count() == 7
        only = back.filter((F.col("warc_type") == "revisit") & F.col("payload_digest").isin(warc.payload_digest(b"same"), "x"))
        assert only.count() == 2 and spark.read.format("warc").option("payload", "false").load(path).filter("payload is not null").count() == 0
        big = warc.page_records(pages(spark), min_bytes=1)
        assert big.filter("warc_type = 'revisit'").count() == 2
    assert warc.page_records(pages(spark).limit(0)).count() == 0


def test_frequent_payloads_shuffled_and_broadcast_alike(spark):
    rows = [(i, f"u{i}", "same" if i % 3 == 0 else "x" * (i % 50), "digest", i) for i in range(400)] + [(None, None, None, "first", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, n long")
    both = [sorted(map(str, warc.page_records(df, broadcast_digests=k).collect())) for k in (0, 10**6)]
    assert both[0] == both[1] and len(both[0]) == 401


def test_unwanted_members_are_not_read(spark, tmp_path):
    warc.register(spark)
    for n, compress in enumerate(["false", "true"]):
        path = f"file:{tmp_path}/i{n}"
        noise = "".join(chr(33 + i * i % 90) for i in range(200_000))
        df = spark.createDataFrame([(1, "u", noise), (2, "u", noise), (3, "u", "own")], "page_id long, url string, html string").coalesce(1)
        warc.page_records(df).coalesce(1).write.format("warc").mode("append").option("path", path).option("compress", compress).save()
        folder = tmp_path / f"i{n}"
        (index,) = folder.glob("*.index")
        at = np.frombuffer(index.read_bytes(), "<i8").reshape(-1, 3)
        archive = index.with_suffix("")
        data = bytearray(archive.read_bytes())
        assert at[-1][0] + at[-1][1] == len(data)
        for offset, size, kind in at.tolist():
            if warc.TYPES[kind] == "response":
                data[offset + 600 : offset + size] = bytes(size - 600) if size > 600 else b""  # payloads ruined
        archive.write_bytes(bytes(data))
        read = spark.read.format("warc").option("payload", "false").load(path)
        assert {r.record_id for r in read.filter("warc_type = 'revisit'").collect()} == {"<urn:page:2>"}
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        assert "Filter (" not in plan(read.filter("warc_type = 'revisit'")) and "Filter (" in plan(read.filter("payload_length = 3"))  # settled by the source
        index.unlink()


def test_paths_name_their_file_system(spark, tmp_path):
    with __import__("pytest").raises(ValueError):
        warc._filesystem("/some/where")
    assert warc.qualified(spark, str(tmp_path)).startswith("file:/")
    assert warc._filesystem(f"file:{tmp_path}")[1] == warc._filesystem(f"file://{tmp_path}")[1] == str(tmp_path)


def test_pushed_predicates_skip_records():
    reader = warc.WarcReader("x", True, False)
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    left = list(reader.pushFilters([EqualTo(("warc_type",), "response"), GreaterThan(("payload_length",), 3), In(("record_id",), ("a", "b"))]))
    assert len(left) == 1 and reader.wanted == {"warc_type": {"response"}, "record_id": {"a", "b"}}


def test_damaged_archives_are_told(tmp_path):
    rec = warc.record_bytes({"warc_type": "response", "record_id": "r", "payload_digest": "WRONG", "payload": b"abc"})
    import io

    for data, verify in ((rec, True), (b"junk", False), (rec[:-8], False)):
        try:
            list(warc.read_records(io.BytesIO(data), {}, True, verify))
        except ValueError:
            continue
        raise AssertionError(data)
