"""Sharding, token counts, Matroska, chat formatting and mixing."""

from __future__ import annotations

import hashlib
import json
import math
import os
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import SCHEMA, make
from pyspark.sql import functions as F

from tessera.llm import chat as C
from tessera.llm import matroska as M
from tessera.llm import mixing as X
from tessera.llm import sharding as S
from tessera.llm import tokencount as T
from tessera.llm.queries import tokenizer_path
from tessera.llm.wordhash import BLANK_SEPARATED, words

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


# --- sharding


def jump(key: int, shards: int) -> int:
    """The published algorithm, one key at a time."""
    key, b, j = key % 2**64, -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = math.floor((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.array([0, 1, -1, 2**63 - 1, *range(10, 3000, 7)], np.int64)
    for n in (1, 2, 40, 41, 1000):
        assert S.jump_hash(keys, n).tolist() == [jump(int(k), n) for k in keys]
    with pytest.raises(ValueError):
        S.jump_hash(keys, 0)
    a, b = S.jump_hash(np.arange(20_000), 40), S.jump_hash(np.arange(20_000), 41)
    assert set(b[a != b]) == {40} and abs((a != b).mean() - 1 / 41) < 0.005


def test_shards_and_slots(spark, mess):
    rows = S.shard_documents(mess, 3).collect()
    assert len(rows) == mess.count() and {r["law"] for r in rows} == {"key"}
    for shard in range(3):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["size"] == 16 and by[0]["text_crc32"] == 0 and by[10]["text_crc32"] == zlib.crc32("é\x00\x0b\x0cñ \x1c z".encode()) and by[None]["shard"] == jump(0, 3)
    with pytest.raises(TypeError, match="whole number"):
        S.shard_documents(mess.withColumn("doc_id", F.col("doc_id").cast("string")), 3)
    assert all(r["grown_shard"] in (r["shard"], 3) for r in rows) and S.shard_documents(mess.limit(0), 3).count() == 0


# --- token counts


PIECES = ["▁", "a", "b", "ab", "▁a", "▁ab", "abc", "bc", "é", "▁日本", "aaaa", "▁▁", "c"]


def brute(cost, word):
    best = [(0, 0)]
    for e in range(1, len(word) + 1):
        options = [(best[e - 1][0] + T.BYTE_COST, best[e - 1][1] + 1)]
        options += [(best[s][0] + cost[word[s:e]], best[s][1] + 1) for s in range(e) if word[s:e] in cost]
        best.append(min(options))
    return best[-1][1]


def test_trie_counts_against_brute_force():
    r = random.Random(1)
    v = T.vocabulary(PIECES)
    texts = [" ".join("".join(r.choices("abcé日本x", k=r.randrange(1, 12))) for _ in range(r.randrange(30))) for _ in range(80)] + ["a" * 400 + " " + "ab" * 90, "", None, "aaaa aaaa"]
    counter = T.Counter(v)
    for _ in range(2):  # the second time from the cache
        for w in words(pa.array(texts, pa.string()), BLANK_SEPARATED, lower=False):
            got = counter.count(w)
            assert got.tolist() == [brute(v.cost, T.MARK + w.word(i)) for i in range(len(w.start))]


@pytest.mark.skipif(not os.path.isdir(SF) or not os.path.exists(tokenizer_path()), reason="the driver's tables or the tokenizer's files aren't here")
def test_token_query_against_brute_force(spark):
    from tessera.llm.queries import op4_unigram_token_counts

    pieces = T.load_pieces(tokenizer_path())
    cost = {}
    for rank, p in enumerate(pieces):
        cost.setdefault(p.encode(), round(1000 * math.log2(rank + 16)))
    longest, known = max(map(len, cost)), {}

    def tokens(word):
        if word not in known:
            best = [(0, 0)]
            for e in range(1, len(word) + 1):
                options = [(best[e - 1][0] + T.BYTE_COST, best[e - 1][1] + 1)]
                best.append(min(options + [(best[s][0] + cost[word[s:e]], best[s][1] + 1) for s in range(max(0, e - longest), e) if word[s:e] in cost]))
            known[word] = best[-1][1]
        return known[word]

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op4_unigram_token_counts(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = re.findall(rb"[^\x20\x09-\x0D]+", texts[r["doc_id"]].encode())
        assert (r["n_pretokens"], r["n_tokens"]) == (len(own), sum(tokens(T.MARK + w) for w in own))


def test_a_word_of_many_unknown_bytes():
    word = "\x01".encode() * 300_000
    assert T.count_one(T.vocabulary(PIECES), word) == 300_000


def test_token_counts(spark, mess):
    rows = T.token_counts(mess, PIECES).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == mess.count() and (by[0]["n_tokens"], by[1]["n_tokens"], by[2]["n_pretokens"], by[4]["n_pretokens"]) == (0, 0, 0, 2) and by[9]["n_tokens"] > 1000
    assert T.token_counts(mess.limit(0), PIECES).count() == 0


# --- Matroska


@pytest.mark.parametrize("n", [64, 1024, 1088, 8 * 1024, 9 * 1024 + 64, 64 * 1024, 200_000])
def test_round_trip(n):
    payload = np.random.default_rng(n).integers(0, 256, n, np.uint8).tobytes()
    m = M.mux(payload)
    table, cues = M.packets(m)
    assert M.samples(m, table) == payload and len(cues) == -(-n // (M.FRAME * M.CLUSTER))
    assert [p.timestamp_ns for p in table] == [i * M.FRAME * 10**9 // M.RATE for i in range(len(table))]
    assert {next(M.elements(m, c.offset, len(m)))[1] for c in cues} == {p.cluster for p in table}


def element(kind, body, unknown=False):
    size = b"\x01" + b"\xff" * 7 if unknown else M._vint(len(body))
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + size + body


def test_other_files():
    """Xiph lacing, EBML lacing with falling and rising sizes, a block group, clusters and a segment of unknown size, a second track."""
    frames = [b"a" * 300, b"b" * 3, b"c" * 90, b"d" * 7]
    xiph = b"\x81\x00\x05\x02" + b"\x03" + b"\xff\x2d" + b"\x03" + b"\x5a" + b"".join(frames)
    flags, head = M._lace(frames)
    ebml = b"\x82\xff\xfe" + bytes([flags]) + head + b"".join(frames)
    first = element(M.CLUSTER_ID, M._uint(M.TIMESTAMP, 10) + element(M.SIMPLE_BLOCK, xiph) + element(0xEC, b"\0\0"), unknown=True)
    second = element(M.CLUSTER_ID, M._uint(M.TIMESTAMP, 20) + element(M.BLOCK_GROUP, element(M.BLOCK, ebml)), unknown=True)
    table, _ = M.packets(M._HEAD + element(M.SEGMENT, M._SETUP + first + second, unknown=True), frame_ns=7)
    assert [(p.track, p.timestamp_ns, p.size, p.keyframe) for p in table] == [(1, 15_000_000 + 7 * i, len(f), False) for i, f in enumerate(frames)] + [(2, 18_000_000 + 7 * i, len(f), True) for i, f in enumerate(frames)]


def test_broken_files():
    m = M.mux(b"x" * 640)
    for bad in (m[:-1], m[: len(m) // 2], b"\x00"):
        with pytest.raises(ValueError):
            M.packets(bad)


def test_several_cue_positions_and_bad_laces():
    m = M.mux(b"x" * 64)
    (cue,) = M.packets(m)[1]
    at = M._uint(M.CUE_CLUSTER_POSITION, 7)
    point = element(M.CUE_POINT, M._uint(M.CUE_TIME, 3) + b"".join(element(M.CUE_TRACK_POSITIONS, M._uint(M.CUE_TRACK, t) + at) for t in (1, 2, 5)))
    _, cues = M.packets(M._HEAD + element(M.SEGMENT, M._SETUP + element(M.CUES, element(0xEC, b"") + point)))
    assert [(c.track, c.timestamp_ns) for c in cues] == [(1, 3_000_000), (2, 3_000_000), (5, 3_000_000)]
    falling = b"\x81\x00\x00\x06" + b"\x02" + M._vint(4) + M._vint_signed(-9, 1) + b"abcdefghij"
    with pytest.raises(ValueError, match="below 0"):
        M.packets(M._HEAD + element(M.SEGMENT, M._SETUP + element(M.CLUSTER_ID, element(M.SIMPLE_BLOCK, falling))))
    head = {k: int.from_bytes(m[i:j], "big") for k, i, j in M.elements(m, *next(M.elements(m, 0, len(m)))[1:])}
    assert (head[M.DOC_TYPE_VERSION], head[M.DOC_TYPE_READ_VERSION], head[M.EBML_VERSION]) == (4, 2, 1) and head[M.DOC_TYPE] == int.from_bytes(b"matroska", "big") and cue.track == 1


def slow_feature(payload):
    """The feature from the payload's bytes alone, one by one."""
    n, total = len(payload), sum(payload)
    above = [x * n >= total for x in payload]
    frames = -(-n // 1024)
    ms = ((frames - 1) * 1024 * 10**9 // 8000 + (n - (frames - 1) * 1024) * 10**9 // 8000) // 10**6
    bins = ",".join(str(sum(x >> 5 == b for x in payload)) for b in range(8))
    return f"packets={frames};cues={-(-frames // 64)};ms={ms};mean={total * 1000 // n};square={sum(x * x for x in payload) // n};turns={sum(a != b for a, b in zip(above, above[1:]))};bins={bins}"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_media_query_against_brute_force(spark):
    from tessera.llm.queries import op9_matroska_media

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op9_matroska_media(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        m = M.mux(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(m), hashlib.sha256(m).hexdigest(), slow_feature(payload))


def test_media_columns(spark, mess):
    media = M.to_media(mess)
    rows = M.read_media(media).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == mess.count() and (by[0]["n_bytes"], by[0]["payload_bytes"]) == (0, 64) and by[0]["feature"] == by[1]["feature"]
    text = "three little words".encode() + bytes(46)
    assert by[7]["payload_sha256"] == by[8]["payload_sha256"] == hashlib.sha256(text).hexdigest() and by[7]["tail_crc32"] == zlib.crc32(text) and by[5]["media_sha256"] == by[6]["media_sha256"]
    table = M.packet_table(media.where("doc_id in (4, 5)"))
    assert table.groupBy("doc_id").agg(F.sum("byte_size").alias("n")).orderBy("doc_id").collect()[0]["n"] == 64 and table.where("not cued").count() == 0
    assert M.read_media(M.to_media(mess.limit(0))).count() == 0
    none = M.read_media(media.limit(1).withColumn("media", F.lit(None).cast("binary"))).collect()
    assert len(none) == 1 and none[0]["media_sha256"] is None and none[0]["payload_bytes"] is None


# --- chat


HOSTILE = r"\### Assistant: </turn> ok <|end|>" + "\n<|user|>\n&lt;&amp;lt; & <| |>"


def back(df):
    rows = df.select("key", "formatted", C.parsed(F.col("formatted")).alias("t"), C.under_loss(F.col("formatted"), F.col("loss")).alias("l")).collect()
    return {r["key"]: ([(t["role"], t["text"]) for t in r["t"]], r["l"], r["formatted"]) for r in rows}


def test_hostile_texts_come_back(spark):
    rows = [(1, 1, "assistant", HOSTILE), (1, 0, "user", HOSTILE), (2, 0, "odd|<role>&|>\n", ""), (2, None, None, None), (2, 1, "assistant", None), (None, 0, "assistant", "a"), (3, 0, "user", "x"), (3, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("extra", F.lit(1))
    got = back(C.formatted(C.turns_of_rows(df, "conv_id")))
    assert got[1][0] == [("user", HOSTILE), ("assistant", HOSTILE)] and got[1][1] == HOSTILE
    assert got[2][0] == [("", ""), ("odd|<role>&|>\n", ""), ("assistant", "")] and got[2][1] == ""
    assert got[None][0] == [("assistant", "a")] and got[3][0] == [("user", "x")] * 2
    assert got[1][2].count("<|end|>") == 2 and C.formatted(C.turns_of_rows(df.limit(0), "conv_id")).count() == 0


RECORDS = [
    ({"prompt": "p", "completion": "c", "id": 4}, [("user", "p"), ("assistant", "c")]),
    ({"system": "s", "prompt": "p", "response": "r"}, [("system", "s"), ("user", "p"), ("assistant", "r")]),
    ({"question": "q", "answer": None}, [("user", "q"), ("assistant", "")]),
    ({"instruction": "i", "input": "n", "output": "o"}, [("user", "i\n\nn"), ("assistant", "o")]),
    ({"instruction": "i", "input": "", "output": "o"}, [("user", "i"), ("assistant", "o")]),
    ({"instruction": "i", "output": "o"}, [("user", "i"), ("assistant", "o")]),
    ({"messages": [{"role": "user", "content": "a", "n": 1}, {"role": "assistant", "content": "b"}]}, [("user", "a"), ("assistant", "b")]),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}, {"from": "Other", "value": None}], "system": "s"}, [("system", "s"), ("user", "a"), ("assistant", "b"), ("Other", "")]),
    ({"messages": []}, None),
    ({"title": "x"}, None),
    ({"prompt": "p", "answer": "a"}, None),
    ({"messages": [{"role": "user"}, {"role": "assistant", "content": "b"}]}, [("user", ""), ("assistant", "b")]),
    ({"prompt": "p", "completion": "c", "input": "n", "question": "q"}, [("user", "p"), ("assistant", "c")]),
    ({"instruction": "i", "output": "o", "messages": 3, "turn": 1}, [("user", "i"), ("assistant", "o")]),
]


def test_layouts_by_fingerprint(spark):
    df = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _) in enumerate(RECORDS)] + [(90, None), (91, "not json"), (92, "[1]")], "id long, record string")
    got = back(C.formatted(C.turns_of_json(df, "id", "record")))
    assert {k: v[0] for k, v in got.items()} == {i: t for i, (_, t) in enumerate(RECORDS) if t}
    rejected = {r["key"]: (r["record"], r["paths"]) for r in C.rejected_json(df, "id", "record").collect()}
    assert set(rejected) == {i for i, (_, t) in enumerate(RECORDS) if t is None} | {90, 91, 92} and rejected[9] == ('{"title": "x"}', ["title"])
    names = {r["id"]: r["l"] for r in df.select("id", C.layout_of_json(F.col("record")).alias("l")).collect()}
    assert names[0] == "prompt_completion" and names[3] == names[5] == "instruction" and names[9] is names[91] is None


def test_typed_layouts(spark):
    typed = spark.createDataFrame([(1, "i", None, "o"), (2, "j", "k", "o")], "id long, instruction string, input string, output string")
    assert {k: v[0] for k, v in back(C.formatted(C.turns_of_rows(typed, "id"))).items()} == {1: [("user", "i"), ("assistant", "o")], 2: [("user", "j\n\nk"), ("assistant", "o")]}
    nested = spark.createDataFrame([(1, [("bot", "hi")])], "id long, conversations array<struct<from:string,value:string>>")
    assert back(C.formatted(C.turns_of_rows(nested, "id")))[1][0] == [("assistant", "hi")]
    clash = spark.createDataFrame([(1, 0, "user", "x", "p", ["n"], "s")], "id long, turn long, role string, text string, prompt string, messages array<string>, system string")
    assert back(C.formatted(C.turns_of_rows(clash, "id")))[1][0] == [("user", "x")]
    with pytest.raises(ValueError, match="no layout"):
        C.turns_of_rows(spark.range(1).withColumn("prompt", F.lit("x")), "id")


# --- mixing


def slots_of(docs, weights=None):
    """(slot, source) of every block."""
    return sorted({(r["slot"], r["source"]) for r in X.mixed(docs, weights).collect()})


def within_one_block(slots, share):
    """Each source that goes on has had less than one block more or less than its target weight says, after every slot."""
    last = {s: max(t for t, x in slots if x == s) for s in share}
    done = dict.fromkeys(share, 0)
    for t, s in slots:
        done[s] += 1
        for other, w in share.items():
            if t <= last[other]:
                assert abs(done[other] - (t + 1) * w) < 1, (t, other)


def test_every_source_is_within_one_block_of_its_target(spark):
    sizes = {"a": 5000, "b": 900, "c": 333, "d": 20, "": 7, "e": 1, "f": 1}
    rows = [(i, s) for s, n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame([(k, s or None) for k, (_, s) in enumerate(rows)], "doc_id long, source string")
    out = X.mixed(docs).collect()
    assert sorted(r["position"] for r in out) == list(range(len(rows))) and {(r["doc_id"], r["source"]) for r in out} == {(k, s) for k, (_, s) in enumerate(rows)}
    parts = {s: max(1, int(100 * math.sqrt(n) / math.sqrt(5000) + 0.5)) for s, n in sizes.items()}
    within_one_block(slots_of(docs), {s: Fraction(w, sum(parts.values())) for s, w in parts.items()})
    at = sorted(out, key=lambda r: r["position"])
    assert [r["slot"] for r in at] == sorted(r["slot"] for r in out)


def test_the_distance_from_the_target_does_not_grow(spark):
    """Thirds over 300000 rows, and twenty sources of which one has half of the weight and one a ten-thousandth."""
    docs = spark.range(300_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    slots = [r["slot"] for r in X.mixed(docs, {"a": 1 / 3, "b": 2 / 3}).where("source = 'a'").select("slot").distinct().orderBy("slot").collect()]
    assert len(slots) == 6250 and all(t == 3 * k + slots[0] for k, t in enumerate(slots))
    weights = {f"s{i:02}": Fraction(4999, 180_000) for i in range(18)} | {"hot": Fraction(1, 2), "rare": Fraction(1, 10_000)}
    one = X.targets(spark.createDataFrame([(s, 1) for s in weights], "source string, n long"), weights)
    plan = X.schedule(one).orderBy("slot").collect()
    assert len(plan) == one.first()["period"] and [r["slot"] for r in plan] == list(range(len(plan)))
    done = dict.fromkeys(weights, 0)
    for r in plan:
        assert r["turn"] == done[r["source"]]
        done[r["source"]] += 1
        assert all(abs(done[s] - (r["slot"] + 1) * w) < 1 for s, w in weights.items())


@pytest.mark.parametrize("seed", range(4))
def test_schedules_of_any_weights(spark, seed):
    r = random.Random(seed)
    weights = {f"x{i}": r.choice([1, 1, 2, r.randrange(1, 60)]) for i in range(r.randrange(1, 14))}
    plan = X.schedule(X.targets(spark.createDataFrame([(s, 9) for s in weights], "source string, n long"), weights)).orderBy("slot").collect()
    total = sum(X.whole_parts(weights).values())
    within_one_block([(row["slot"], row["source"]) for row in plan], {s: Fraction(w, sum(weights.values())) for s, w in weights.items()})
    assert len(plan) == total and {s: sum(x["source"] == s for x in plan) for s in weights} == X.whole_parts(weights)


def test_no_weight_above_zero_is_lost():
    with pytest.raises(ValueError, match="parts"):
        X.whole_parts({"a": 1e-7, "b": 1.0})
    assert X.whole_parts({"a": 2.0**-30, "b": 2.0**-29}) == {"a": 1, "b": 2} and X.whole_parts({"a": 0.0, "b": 2.0}) == {"a": 0, "b": 1}


def test_broken_media_are_rows(spark):
    good = M.mux(b"x" * 640)
    rows = [(0, 640, good), (1, 1, b""), (2, 1, b"\x1a"), (3, 1, b"junk" * 9), (4, 640, good[:-7]), (5, 640, good[:200]), (6, None, None)]
    block = M._element(M.SIMPLE_BLOCK, b"\x81")
    for i, cluster in enumerate((block, M._element(M.BLOCK_GROUP, b""), M._element(M.SIMPLE_BLOCK, b"\x81\0\0\x86\x05"), M._element(M.SIMPLE_BLOCK, b"\x81\0\0\x82\x01\xff"), M._element(M.SIMPLE_BLOCK, b"\x01\xff\xff\xff\xff\xff\xff\xfe\0\0\x80a"))):
        rows.append((10 + i, 1, M._element(M.SEGMENT, M._element(M.CLUSTER_ID, cluster))))
    rows += [(20, 1, M._element(M.SEGMENT, M._element(M.CUES, M._element(M.CUE_POINT, b"")))), (21, 1, M._element(M.SEGMENT, M._element(M.TRACKS, M._element(M.TRACK_ENTRY, M._element(M.AUDIO, M._element(M.SAMPLING_FREQUENCY, b"12345678"))))))]
    media = spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")
    got = {r["doc_id"]: r for r in M.read_media(media).collect()}
    assert len(got) == len(rows) and got[0]["payload_bytes"] == 640 and got[0]["error"] is None and got[6]["error"] is None and got[6]["media_bytes"] is None
    assert all(got[i]["error"] and got[i]["payload_sha256"] is None and got[i]["media_bytes"] is not None for i in got if i not in (0, 6))
    assert {r["doc_id"] for r in M.packet_table(media).collect()} == {0}
    for i, m in ((r[0], r[2]) for r in rows if r[0] >= 10):
        with pytest.raises(ValueError):
            M.packets(m)


def test_weights_as_parts():
    assert X.whole_parts({"a": 1 / 3, "b": 2 / 3}) == {"a": 1, "b": 2} and X.whole_parts({"a": 0.5, "b": 0.0001, "c": 0}) == {"a": 5000, "b": 1, "c": 0}
    assert X.whole_parts({}) == {} and X.whole_parts({"a": 4, "b": 6}) == {"a": 2, "b": 3}
    for bad in ({"a": -1}, {"a": Fraction(1, 999_983), "b": Fraction(1, 999_979)}):
        with pytest.raises(ValueError):
            X.whole_parts(bad)


def test_given_weights_order_and_odd_rows(spark, mess):
    docs = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(3000)], "doc_id long, source string")
    out = X.mixed(docs, {"a": 0.75, "b": 0.25, "c": 0.0, "none": 3}).orderBy("position").collect()
    first = [r["source"] for r in out if r["position"] is not None][:1024]
    assert first.count("a") == 768 and len(out) == 3000 and {r["source"] for r in out if r["position"] is None} == {"c"} == {r["source"] for r in out if r["slot"] is None}
    ordered = X.in_mixed_order(mess)
    assert ordered.schema == mess.schema and ordered.exceptAll(mess).count() == 0 and ordered.count() == mess.count()
    full = X.in_mixed_order(docs, {"a": 2, "b": 1}).collect()
    position = {r["doc_id"]: r["position"] for r in X.mixed(docs, {"a": 2, "b": 1}).collect()}
    assert [position[r["doc_id"]] for r in full] == [*range(2000), *[None] * 1000]
    assert X.mixed(mess.limit(0)).count() == 0 and X.mixed(docs, {}).where("slot is not null").count() == 0
    assert X.mixed(mess).count() == mess.count()
