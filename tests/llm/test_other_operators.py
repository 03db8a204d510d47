"""Mixing, media, licences, sharding, personal data, toxicity and the pipeline on small inputs, edge cases included."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textquarry.llm import licences, media, mixing, pii, queries, sharding, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGE = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "no id here", "en", "a", 0), (4, "twice", "en", "b", 0), (4, "twice", "en", "b", 0), (5, "word " * 30_000, "en", "b", 0), (6, "same text", "en", "c", 0), (7, "same text", "en", "c", 0)]


def docs(spark, table, rows):
    return table("documents", rows, DOCS)


# ---- mixing --------------------------------------------------------------------------------------------------------
def test_targets():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    assert mixing.targets([10, 100], [3, 1]) == [30, 80]
    assert mixing.targets([], [], 3) == [] and mixing.targets([0, 0], [1, 2]) == [0, 0]


def test_splitting_tree_is_exact():
    quotas = np.array([70, 3, 0, 500])
    runs = [mixing.leaf(quotas, 13, k, 1) for k in range(13)]
    for s in range(4):
        at = 0
        for start, count in runs:
            assert start[s] == at
            at += count[s]
        assert at == quotas[s]
    sizes = [int(c.sum()) for _, c in runs]
    assert max(sizes) - min(sizes) <= 4 and all((a[1] == b[1]).all() for a, b in zip(runs, [mixing.leaf(quotas, 13, k, 1) for k in range(13)], strict=True))


def test_op2(spark, table):
    rng = random.Random(4)
    rows = [(k, "w " * rng.randint(0, 50), "en", rng.choice(["b", "a", "Z", "é", None, "big", "big", "big"]), 0) for k in range(900)]
    d = docs(spark, table, rows)
    got = queries.op2_mixing(spark, d).collect()
    again = queries.op2_mixing(spark, d).collect()
    assert {(r["doc_id"], r["taken"]) for r in got} == {(r["doc_id"], r["taken"]) for r in again}
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(r[1].split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, mixing.targets([sizes[s] for s in order], [1 + k % 3 for k in range(len(order))]), strict=True))
    assert len(got) == len(rows)
    for s in order:
        mine = [r for r in got if r["source"] == s]
        assert {r["source_size"] for r in mine} == {sizes[s]} and all(abs(r["target"] - goal[s]) < 1e-6 for r in mine)
        assert sum(r["taken"] for r in mine) == round(goal[s]) and all(r["taken"] <= 3 * r["size"] for r in mine)


def test_mixed_documents(spark, table):
    rng = random.Random(4)
    d = docs(spark, table, [(k, f"t{k} " * rng.randint(1, 9), "en", rng.choice("abc"), 0) for k in range(300)])
    src = spark.read.parquet(f"{d}/documents.parquet")
    out = mixing.mixed_documents(src, docs_per_block=16, blocks_per_shard=4)
    assert out.columns == src.columns
    plan = {r["doc_id"]: r for r in mixing.mix(src, docs_per_block=16, blocks_per_shard=4, cut_last=False).collect()}
    count = {}
    for r in out.collect():
        count[r["doc_id"]] = count.get(r["doc_id"], 0) + 1
    assert count == {k: r["taken"] // r["size"] for k, r in plan.items() if r["taken"]}


def test_op2_equals_brute_force(spark, table):
    """Words taken by document, in plain Python: whole passes, then blocks in order, then the documents of one block in hash order."""
    import random

    rng = random.Random(4)
    docs = [(k, " ".join(["w"] * rng.randint(0, 40)) if k % 17 else None, "en", rng.choice(["a", "b", "b", "c", None]), 0) for k in range(900)]
    d = table("documents", docs, DOCS)
    df = spark.read.parquet(f"{d}/documents.parquet")
    hashes = {r["doc_id"]: r["h"] for r in df.select("doc_id", F.xxhash64(F.lit(17), F.col("doc_id").cast("long"), F.col("source").cast("string")).alias("h")).collect()}
    names = sorted({s for *_, s, _ in docs if s}) + [None]
    size = {k: len((t or "").split()) for k, t, *_ in docs}
    of = {s: [k for k, _, _, x, _ in docs if x == s] for s in names}
    totals = [sum(size[k] for k in of[s]) for s in names]
    goal = mixing.targets(totals, [1, 2, 3, 1])
    want = {}
    for s, total, target in zip(names, totals, goal, strict=True):
        blocks = max(1, -(-len(of[s]) // 64))
        passes, rest = divmod(round(target), total)
        place = {k: min(int(((hashes[k] & (2**64 - 1)) >> 11) / 2**53 * blocks), blocks - 1) for k in of[s]}
        for k in sorted(of[s], key=lambda k: (place[k], hashes[k], k, size[k])):
            some = min(size[k], rest)
            rest -= some
            want[k] = passes * size[k] + some
    got = {r["doc_id"]: r["taken"] for r in mixing.mix(df, docs_per_block=64, blocks_per_shard=3).collect()}
    assert got == want and sum(goal) == sum(totals)


def test_op2_edges(spark, table):
    got = queries.op2_mixing(spark, docs(spark, table, EDGE)).collect()
    assert len(got) == len(EDGE) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert queries.op2_mixing(spark, docs(spark, table, [])).collect() == []
    assert [r["taken"] for r in queries.op2_mixing(spark, docs(spark, table, [(1, None, None, None, None)])).collect()] == [0]


# ---- media ---------------------------------------------------------------------------------------------------------
@settings(max_examples=60, deadline=None)
@given(st.integers(0, 60_000), st.integers(0, 5))
def test_chunks_round_trip(size, seed):
    data = random.Random(seed).randbytes(size)
    ends = media.cuts(data)
    assert b"".join(media.chunks(data)) == data
    assert all(b - a <= media.MOST for a, b in zip([0, *ends], ends, strict=False)) and all(b - a >= media.LEAST for a, b in zip([0, *ends], ends[:-1], strict=False))
    slow, h = [], 0
    at = 0
    for k, byte in enumerate(data):  # the rolling form
        h = ((h << 1) + int(media.GEAR[byte])) & 0xFFFFFFFF
        if (k + 1 - at >= media.LEAST and h < 1 << (32 - media.BITS) or k + 1 - at == media.MOST) and len(data) - at > media.LEAST:
            slow.append(k + 1)
            at = k + 1
    assert ends == (slow if slow and slow[-1] == len(data) else [*slow, len(data)])


def test_wave():
    n, payload = media.payload_of("é")
    assert (n, len(payload), len(media.payload_of(None)[1]), len(media.payload_of("x" * 64)[1])) == (2, 64, 64, 64)
    assert media.samples(media.wave(payload)) == payload
    with pytest.raises(ValueError):
        media.samples(media.wave(payload)[:-1])


def test_op3_stores_equal_rows_and_shared_chunks_once(spark, table, tmp_path):
    import random

    body = "".join(random.Random(1).choices("abcdefgh ", k=40_000))
    docs = [(7, body, "en", "s", 0)] * 1000 + [(k, body + str(k), "en", "s", 0) for k in range(20, 30)] + [(None, None, None, None, None)] * 3
    d = table("documents", docs, DOCS)
    path = str(tmp_path / "media")
    media.write_media(spark.read.parquet(f"{d}/documents.parquet"), path)
    stored = spark.read.schema(media.STORE + ", kind string").parquet(path)
    held = stored.where("kind = 'chunk'").collect()
    assert len({bytes(r["digests"][0]) for r in held}) == len(held) > 3 and stored.where("kind = 'media'").count() == 12
    got = media.read_media(spark, path).collect()
    assert len(got) == len(docs) and sorted(str(r["doc_id"]) for r in got) == sorted(str(x[0]) for x in docs)
    assert {bytes(r["media"]) for r in got if r["doc_id"] == 7} == {media.wave(media.payload_of(body)[1])}


@pytest.mark.parametrize("bound", [200_000, 0])
def test_op3(spark, table, tmp_path, bound):
    rng = random.Random(8)
    shared = "".join(rng.choices("abcdef ", k=9000))
    rows = [*EDGE, *[(100 + k, shared + str(k) * 3000, "en", "s", 0) for k in range(6)], *[(200 + k, shared, "en", "s", 0) for k in range(5)]]
    d = docs(spark, table, rows)
    path = str(tmp_path / f"store{bound}")
    media.write_media(spark.read.parquet(f"{d}/documents.parquet"), path, broadcast_rows=bound)
    got = media.features(media.read_media(spark, path)).collect()
    assert len(got) == len(rows)
    want = []
    for i, text, *_ in rows:
        n, payload = media.payload_of(text)
        want.append((str(i), n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(payload) + 44, hashlib.sha256(media.wave(payload)).hexdigest()))
    assert sorted((str(r["doc_id"]), *[r[c] for c in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")]) for r in got) == sorted(want)
    assert len({(r["payload_sha256"], r["feature"]) for r in got}) == len({r["payload_sha256"] for r in got})
    kept = spark.read.parquet(path).agg(F.sum(F.length("data"))).first()[0]
    assert kept < sum(w[5] for w in want) - 3 * 9000  # shared chunks are stored once
    assert media.read_media(spark, _empty_store(spark, table, tmp_path, bound)).collect() == []


def _empty_store(spark, table, tmp_path, bound):
    path = str(tmp_path / f"none{bound}")
    media.write_media(spark.read.parquet(f"{docs(spark, table, [])}/documents.parquet"), path)
    return path


# ---- licences ------------------------------------------------------------------------------------------------------
def test_op6(spark, table):
    mit = licences.KNOWN["MIT"]
    rows = [(11, "Copyright (c) 2024 Someone\n\n" + mit.upper().replace("\n", "\r\n\r\n"), "", "", 0), (12, mit.replace("sublicense", "sub-license") + "\n(c) 2020 A\n", "", "", 0), (13, mit + " more", "", "", 0), (14, "Licenced under CC BY-NC 4.0", "", "", 0), (15, "licensed under the apache licence version 2.0", "", "", 0), *EDGE]
    d = docs(spark, table, rows)
    got = {r["doc_id"]: r["licence"] for r in queries.op6_licences(spark, d).collect() if r["doc_id"]}
    assert (got[11], got[12], got[13], got[15], got[6]) == ("MIT", "MIT", None, "Apache-2.0 line", None)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet/*.parquet'")
    key = lambda r: tuple(str(x) for x in r)
    want = con.execute(queries.oracle_sql()["op6_licences"]).fetchall()
    assert sorted(map(key, want)) == sorted(key(r) for r in queries.op6_licences(spark, d).collect())


def test_own_licences_and_clear(spark, table):
    from textquarry.llm import storage

    own = licences.digests(spark.createDataFrame([("House", "Use it WELL."), ("House again", "use it well")], "licence string, text string"))
    d = docs(spark, table, [(1, "(c) 2020 Me\nUse -- it well!", "", "", 0), (2, "use it", "", "", 0)])
    assert [r["licence"] is not None for r in licences.scan(spark.read.parquet(f"{d}/documents.parquet"), known=own).orderBy("doc_id").collect()] == [True, False]
    kept = storage.materialise(spark.range(3), "t")
    assert kept.count() == 3 and storage.clear(spark) >= 1 and storage.clear(spark) == 0


# ---- sharding ------------------------------------------------------------------------------------------------------
def brute_shards(rows, limit):
    hashed = [int(hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest()[:8], 16) for r in rows]
    size = [len((r[1] or "").encode()) for r in rows]
    out = {}
    for h in hashed:
        for depth in range(33):
            total = sum(n for g, n in zip(hashed, size, strict=True) if g >> 32 - depth == h >> 32 - depth)
            if total <= limit or depth == 32:
                out[h] = (depth, h >> 32 - depth, total)
                break
    return [out[h] for h in hashed]


def test_op7(spark, table):
    rng = random.Random(6)
    rows = [*EDGE[:5], *[(k, "x" * rng.randint(0, 60), "", "", 0) for k in range(10, 200)]]
    d = docs(spark, table, rows)
    got = sharding.shard(spark.read.parquet(f"{d}/documents.parquet"), limit=300).collect()
    want = brute_shards(rows, 300)
    assert sorted((str(r["doc_id"]), r["bytes"], r["depth"], r["prefix"], r["shard_bytes"]) for r in got) == sorted((str(r[0]), len((r[1] or "").encode()), *w) for r, w in zip(rows, want, strict=True))
    assert all(len(r["shard"]) == r["depth"] for r in got)


def test_op7_overflow(spark, table):
    rows = [*[(9, "y" * (k % 50), "", "", 0) for k in range(200)], (9, "z" * 500, "", "", 0), *[(k, "x" * 20, "", "", 0) for k in range(20, 60)]]
    got = sharding.shard(spark.read.parquet(f"{docs(spark, table, rows)}/documents.parquet"), limit=300).collect()
    assert len(got) == len(rows)
    total = {}
    for r in got:
        total.setdefault(r["shard"], []).append(r["bytes"])
    assert all(sum(v) <= 300 or len(v) == 1 for v in total.values())
    assert all(sum(total[r["shard"]]) == r["shard_bytes"] for r in got)
    assert queries.op7_sharding(spark, docs(spark, table, [])).collect() == []


# ---- personal data -------------------------------------------------------------------------------------------------
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(int(c) * (2 if k % 2 else 1), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def brute_base(text):
    out = []
    for rank, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(12)
    bits = ["a", "b@c", "@", ".", "1", "25", "255", "4111 1111 1111 1111", "4012888888881881", "+49 (30) 123-4567", " ", "-", "é", "_", "x.y", "\n", "+", "(", "1.2.3.4", "300.1.1.1", "007.1.1.1"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 25))) for _ in range(3000)] + ["", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "a" * 5000 + "@b.c", "1" * 5000, "1." * 3000, "+1" + "2 " * 3000]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(8).select("k", pii.base_spans(F.col("t")).alias("b")).collect()
    for r in got:
        assert [(s["start"], s["rank"], s["end"], s["kind"]) for s in r["b"]] == brute_base(texts[r["k"]])


def test_op9_discovers(spark, table):
    rows = [(k, f"Hello there. My badge phone: +4930123{k:04d}99 thanks {k}", "", "", 0) for k in range(30)]
    rows += [(100, "é é Hello. My badge phone: 030-5551234, thanks", "", "", 0), (101, "about 1234567 things", "", "", 0), *EDGE[:5]]
    got = queries.op9_pii(spark, docs(spark, table, rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[0]["spans"] == "phone:29:43" and by[0]["n_phone"] == 1
    assert by[100]["n_phone"] == 0 and by[100]["spans"] == "phone:27:38" and by[101]["spans"] == ""
    assert by[1]["base_sha256"] != hashlib.sha256(b"").hexdigest() and by[4]["base_sha256"] is not None
    for r in got:
        text = next(x[1] for x in rows if x[0] == r["doc_id"])
        base = brute_base(text)
        if r["doc_id"] not in (1, 2, 4):
            assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in base).encode()).hexdigest()
    clean = pii.redact(spark.read.parquet(f"{docs(spark, table, rows)}/documents.parquet")).collect()
    text = {r["doc_id"]: r["text"] for r in clean}
    assert text[100] == "é é Hello. My badge phone: <PHONE>, thanks" and text[101] == "about 1234567 things" and len(clean) == len(rows)
    assert queries.op9_pii(spark, docs(spark, table, [])).collect() == []


# ---- toxicity ------------------------------------------------------------------------------------------------------
def test_exceptions_take_back_all_that_matches_inside():
    lexicon = {" trash": 3.0, " tras": 2.0, " can ": 1.5, " clow": 1.0}
    out = toxicity.excepted(lexicon)
    assert out[" trash can "] == -6.5 and out[" class clown "] == -1.0 and " sore loser " not in out
    whole = tuple(sorted((lexicon | out).items()))
    naive = lambda t: sum(w * sum(t.startswith(e, k) for k in range(len(t))) for e, w in whole)
    texts = ["The trash can, the TRASH CAN!", "tr4sh bin can", "class clown trash", "", None, "a trash can trash " * 2000, "trаsh"]
    assert [toxicity._features([t], whole)[0][0] for t in texts] == [naive(toxicity.fold(t)) for t in texts]
    assert toxicity._features(["Put it in the trash can."], whole)[0][0] == 0


def test_fold():
    assert toxicity.fold("You 1D10T!").strip() == "you idiot" and toxicity.fold("іdіоt") == " idiot " and toxicity.fold(None) == "  "


def test_op10(spark, table):
    rng = random.Random(3)
    words = [f"word{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(900):
        w = rng.choices(words, k=rng.randint(20, 120))
        bad = k % 8 == 0
        if bad:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["grumblefex", "zorkling", "zorklings"]) if k % 16 else rng.choice(["1diot", "mоron"])
        rows.append((k, " ".join(w), "en", "s", 0))
        labels.append((k, 1, int(bad)))
    rows += [(1000, "throw it in the trash can please", "en", "s", 0), (1001, None, None, None, None), (1002, "", "en", "s", 0)]
    d = docs(spark, table, rows)
    table("labels", labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in queries.op10_toxicity(spark, d).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    test = [(got[k]["predicted"], y) for k, _, y in labels if got[k]["held_out"]]
    assert sum(p == y for p, y in test) / len(test) > 0.97
    assert [got[k]["predicted"] for k in (1000, 1001, 1002)] == [0, 0, 0]
    table("labels", [], "doc_id long, quality int, toxic int")
    bare = {r["doc_id"]: r["predicted"] for r in queries.op10_toxicity(spark, d).collect()}
    assert bare[16] == 1 and bare[1] == 0
    model = toxicity.fit(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    clashing = spark.createDataFrame([(1, "you idiot moron", 0.5), (2, "fine", 0.7)], "doc_id long, text string, toxicity double")
    assert [tuple(r) for r in toxicity.reject(clashing, model).collect()] == [(2, "fine", 0.7)]


# ---- the pipeline --------------------------------------------------------------------------------------------------
def test_pipeline_equals_its_stages(spark, table):
    import corpus_pipeline

    rng = random.Random(21)
    words = [f"term{k}" for k in range(500)]
    rows = [(k, " ".join(rng.choices(words, k=60)), "en", "ab"[k % 2], 0) for k in range(120)]
    rows += [(200 + k, rows[5][1], "en", "a", 0) for k in range(5)]
    rows += [(300, "you idiot moron scum stupid idiot moron loser", "en", "a", 0), (301, "write to some.one@mail.example.com now please or never again", "en", "b", 0)]
    d = docs(spark, table, rows)
    table("labels", [(k, 1, 0) for k in range(120)], "doc_id long, quality int, toxic int")
    kept = spark.read.parquet(f"{d}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, d)
        assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
        seen[name] = {r["doc_id"]: r for r in kept.collect()}
    assert 300 not in seen["toxicity"] and len(seen["toxicity"]) == len(rows) - 1
    assert set(seen["simhash"]) == set(seen["toxicity"]) - {200 + k for k in range(5)}
    assert "<EMAIL>" in seen["pii"][301]["text"] and seen["pii"][301]["n_chars"] == len(seen["pii"][301]["text"])
    out = corpus_pipeline.run(spark, d).collect()
    assert {r["doc_id"] for r in out} == set(seen["mixing"]) and all(len(r["ids"]) == 4 * r["length"] for r in out)
    # the pieces of each document are its redacted text, once for each copy
    from tokenizers import Tokenizer

    from textquarry.llm.tokens import tokenizer_path

    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    copies = {r["doc_id"]: r["n"] for r in kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    for i, r in seen["mixing"].items():
        ids = [*tok.encode(r["text"], add_special_tokens=False).ids, 0]
        mine = sorted((x["start"], bytes(x["ids"])) for x in out if x["doc_id"] == i)
        assert mine == sorted((a, np.array(ids[a : a + 1024], "<u4").tobytes()) for a in range(0, len(ids), 1024) for _ in range(copies[i]))
    # what mixing may take: its own rule by brute force
    size = {i: len(r["text"].split()) for i, r in seen["pii"].items()}
    source = {i: r["source"] for i, r in seen["pii"].items()}
    goal = dict(zip("ab", mixing.targets([sum(n for i, n in size.items() if source[i] == s) for s in "ab"], [1, 2]), strict=True))
    for s in "ab":
        got = sum(size[i] * n for i, n in copies.items() if source[i] == s)
        assert abs(got - goal[s]) <= max(size.values())


def test_extra_columns_keep_their_names(spark, table):
    """Columns named like the operators' own are neither read nor changed."""
    from textquarry.llm import embed, packing, simhash, token_output

    names = ["size", "h", "row", "key", "bytes", "fp", "root", "component_id", "spans", "base", "draws", "block", "shard", "toxicity", "digest", "form", "n", "label", "v"]
    rows = [(k, f"some text number {k % 3} with mail{k % 3}@a.example.org", "en", "ab"[k % 2], 0, *[f"{c}{k}" for c in names]) for k in range(9)]
    d = table("documents", rows, DOCS + "".join(f", {c} string" for c in names))
    src = spark.read.parquet(f"{d}/documents.parquet")
    for out in (simhash.keep_one(src), pii.redact(src), mixing.mixed_documents(src)):
        assert out.columns == src.columns
        assert all(r[c] == f"{c}{r['doc_id']}" for r in out.collect() for c in names)
    for op in (mixing.mix, sharding.shard, licences.scan, packing.pack_documents, pii.find, simhash.near_duplicates, media.media_features):
        assert op(src).count() == 9
    token_output.write_tokens(src, path := f"{d}/tokens")
    assert token_output.read_tokens(spark, path).count() == 9
    v = src.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"), F.lit(1).alias("label"), "row", "n", "v")
    assert {r["n_links"] for r in embed.near_vectors(v).collect()} == {8}
