"""SentencePiece against the library, fingerprints against generalised Jaccard, chats, the pipeline."""

import hashlib
import json
import random
import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as proto

import corpus_pipeline
from riskloom.llm import chat, cws, lines, mixing, spieces
from test_llm_similar import brute_groups

TEXTS = [None, "", " ", "Hello world", "  two  spaces   three    four ", "tabs\tand\nnew\n\nlines \n x", "unbelievable antidisestablishmentarianism don't (e.g.) a.b,c;d", "你好 世界。☃ été naïve Straße",
         "x = [1, 2]; foo(bar)->baz != 0x1F\r\n", "▁escaped", "<s> <0x0A> <unk>", "a" * 300, "ab" * 500 + "。" * 70, "é" * 200, "=" * 90 + " " * 40 + "!", "snake_case __init__ a_b", "Hello world"]


def decoded(t):
    return (t or "").replace("▁", " ")


@pytest.mark.parametrize("seed", [0, 1])
def test_ids_equal_the_library(table, seed):
    rng = np.random.default_rng(seed)
    letters = list("abcdefgh  ▁.,;:!?'\"()_-\n\té你ß0123456789ABC")
    texts = TEXTS + ["".join(rng.choice(letters, rng.integers(1, 120))) for _ in range(200)]
    pieces = spieces.Pieces()
    got = {r["doc_id"]: r for r in spieces.encode(table(texts).withColumn("ids", F.lit("clash")), pieces).withColumn("back", spieces.decode(F.col("ids"), pieces)).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=spieces.MODEL)
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i]["ids"] == library.encode(t or ""), t
        assert got[i]["back"] == decoded(t) and got[i]["n_pieces"] == len(got[i]["ids"])
        assert got[i]["text_sha256"] == hashlib.sha256(decoded(t).encode()).hexdigest()


def test_viterbi_equals_the_library_in_unigram_mode(table):
    model = proto.ModelProto()
    with open(spieces.MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    pieces = spieces.Pieces(unigram=True)
    texts = [t for t in TEXTS if "▁" not in (t or "")]
    for r in spieces.encode(table(texts), pieces).collect():
        assert r["ids"] == library.encode(texts[r["doc_id"]] or ""), texts[r["doc_id"]]


def runs(seed):
    """Unbroken runs on both sides of ``RUN``: letters, one letter, other scripts, characters without a piece, white space."""
    rng = random.Random(seed)
    sizes = [spieces.RUN - 2, spieces.RUN - 1, spieces.RUN, spieces.RUN + 1, 5000, 30_000]
    kinds = ["abcdefghijklmnopqrstuvwxyz", "a", "étéßñ", "字漢語中文", "ab\U0001f9ff\U00013000", " ", "=-_", "0123456789abcdef"]
    return ["".join(rng.choices(k, k=n)) for k in kinds for n in rng.sample(sizes, 3)] + ["in " + "th" * 2500 + " the end\n" + "the" * 700]


def test_long_runs_equal_the_library(table):
    texts = runs(4)
    library = sentencepiece.SentencePieceProcessor(model_file=spieces.MODEL)
    for r in spieces.encode(table(texts), spieces.Pieces()).collect():
        assert r["ids"] == library.encode(texts[r["doc_id"]]), texts[r["doc_id"]][:40]


def test_units_hold_whole_chunks():
    """Chunks cut unit by unit are those of the whole text."""
    cut = re.compile(spieces.Pieces().chunk_pattern())
    rng = random.Random(8)
    for text in [t or "" for t in TEXTS] + ["".join(rng.choices("ab.,_9é \n\t▁", k=rng.randint(1, 60))) for _ in range(2000)]:
        text = spieces.prepared(text).decode()
        assert [c for u in spieces.units(text) for c in cut.findall(spieces.SPACE + u)] == cut.findall(text), text


def mixed_texts(seed):
    rng = random.Random(seed)
    return [t or "" for t in TEXTS] + ["".join(rng.choices("ab.,_9é字 \n\t▁Q", k=rng.randint(1, 60))) for _ in range(2000)]


def test_units_by_arrow_equal_units():
    texts = [spieces.prepared(t) for t in mixed_texts(9)]
    order, found = spieces.unit_lists(texts)
    assert sorted(order) == list(range(len(texts)))
    for i, units in zip(order, found.to_pylist()):
        assert [u.decode() for u in units] == spieces.units(texts[i].decode()), texts[i]
    assert spieces.unit_lists([b""])[1].to_pylist() == [[]]


def test_chunks_are_cut_between_characters_no_piece_joins():
    pieces = spieces.Pieces()
    coarse, pairs = re.compile(pieces.chunk_pattern()), set(pieces.pairs)
    units = sorted({u for t in mixed_texts(10) for u in spieces.units(spieces.prepared(t).decode())})
    chunks, many = spieces.chunker(pieces.pairs)(units)
    assert sum(many) == len(chunks)
    at = 0
    for u, n in zip(units, many):
        own, at, whole = chunks[at:at + n], at + n, spieces.SPACE + u
        assert "".join(own) == whole
        assert all(a[-1] + b[0] not in pairs for a, b in zip(own, own[1:])) and all(c[i:i + 2] in pairs for c in own for i in range(len(c) - 1)), u
        ends = {sum(map(len, own[:i])) for i in range(len(own))}
        assert {m.start() for m in coarse.finditer(whole)} <= ends, u
    assert spieces.chunker(pieces.pairs)([])[0] == []


def test_lattice_gets_few_chunks_and_small_tasks(table, monkeypatch):
    """Numbers are single digits to the model, so the lattice gets digits, not numbers, in more tasks than the other steps have."""
    seen, encoded = [], spieces.encoded_chunks

    def spy(chunks, pieces):
        out = encoded(chunks, pieces)
        seen.append((chunks.count(), out.rdd.getNumPartitions(), spieces.partitions(chunks)))
        return out

    monkeypatch.setattr(spieces, "encoded_chunks", spy)
    text = " ".join(map(str, range(3000)))
    library = sentencepiece.SentencePieceProcessor(model_file=spieces.MODEL)
    assert spieces.encode(table([text]), spieces.Pieces()).first()["ids"] == library.encode(text)
    chunks, tasks, others = seen[0]
    assert chunks <= 11 and tasks == spieces.SLICES * others > others


def test_spelled_out_joins_pieces():
    import pyarrow as pa

    spelled = pa.array([b"", b"ab", "é".encode(), b" "], pa.binary())
    for ids in ([], [0], [0, 0], [1, 2, 3, 1], [3]):
        assert spieces.spelled_out(spelled, np.array(ids, np.int32)) == b"".join(spelled[i].as_py() for i in ids)


def test_decoded_hash_is_that_of_decode(table):
    pieces = spieces.Pieces()
    for r in spieces.encode(table(TEXTS), pieces).withColumn("back", F.sha2(spieces.decode(F.col("ids"), pieces), 256)).collect():
        assert r["decoded_sha256"] == r["back"] == r["text_sha256"]


def test_run_of_more_than_two_million_characters(table):
    text = "".join(random.Random(6).choices("abcdefgh", k=2_200_000)) + " end"
    library = sentencepiece.SentencePieceProcessor(model_file=spieces.MODEL)
    pieces = spieces.Pieces()
    row = spieces.encode(table([text]), pieces).withColumn("back", spieces.decode(F.col("ids"), pieces)).first()
    assert row["ids"] == library.encode(text) and row["back"] == text


def test_runs_by_viterbi_equal_the_fold():
    """``viterbi_run`` against ``viterbi`` over packed edges."""
    pieces = spieces.Pieces(unigram=True)
    table = dict(zip(pieces.pieces, pieces.scores))
    known = {x: (r, i) for x, r, i in zip(pieces.pieces, pieces.ranks, pieces.ids)}
    unknown = min(pieces.scores) - 10.0
    for run in [x[:400] for x in runs(5)]:
        run = run.replace(" ", spieces.SPACE).replace("\n", "")
        edges = sorted((known[t][0] << 47) | (s << 26) | (n << 20) | known[t][1] for s in range(len(run)) for n in range(1, pieces.longest + 1)
                       if s + n <= len(run) and (t := run[s:s + n]) in known)
        edges += [(i << 26) | (1 << 20) | spieces.UNKNOWN for i, c in enumerate(run) if c not in known]
        path = spieces.viterbi(len(run), edges, dict(zip(pieces.ids, pieces.scores)), unknown)
        want = [run[(x >> 26) & 0x1FFFFF:][:(x >> 20) & 63] for x in path]
        assert spieces.viterbi_run(run, table, pieces.longest, unknown) == want, run[:40]


def test_every_piece_merges_in_rank_order():
    """What the fold over ranks relies on: a piece's text, merged by rank alone, gives the piece."""
    pieces = spieces.Pieces()
    rank = dict(zip(pieces.pieces, pieces.ranks))
    for text in pieces.pieces:
        if rank[text] in pieces.tied:  # these take the exact way
            continue
        n = len(text)
        edges = sorted((rank[text[i:j]], i, j) for i in range(n) for j in range(i + 2, n + 1) if text[i:j] in rank)
        bounds = set(range(n + 1))
        for _, i, j in edges:
            inside = [b for b in bounds if i < b < j]
            if i in bounds and j in bounds and len(inside) == 1:
                bounds.discard(inside[0])
        assert bounds == {0, n}, text


def test_encode_nulls_repeats_and_empty(table):
    pieces = spieces.Pieces()
    assert spieces.encode(table(["a"]).where("false"), pieces).count() == 0
    got = spieces.encode(table(["same text", "same text", None], [None, 1, 1]), pieces).collect()
    assert sorted((str(r["doc_id"]), len(r["ids"])) for r in got) == [("1", 0), ("1", 2), ("None", 2)]


def jaccard(a, b):
    a, b = (Counter((x or "").lower().split()) for x in (a, b))
    both = sum((a | b).values())
    return sum((a & b).values()) / both if both else 1.0


def test_fingerprints_of_texts_and_edits(table):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(60)], rng.integers(1, 200))) for _ in range(150)] + [None, "", " ", "x", "日本語 テキスト", "y" * 40_000]
    texts += texts[:3]
    ids = [int(i) for i in rng.permutation(10_000)[: len(texts)]]
    order = np.argsort(ids)
    got = {r["doc_id"]: r for r in cws.fingerprint(table(texts, ids, parts=6).withColumn("rid", F.lit("clash"))).collect()}
    assert len(got) == len(texts)
    errors = []
    for k, at in enumerate(order):
        t, after = texts[at] or "", texts[order[(k + 1) % len(order)]] or ""
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        r = got[ids[at]]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        errors += [r["near_edited"] - jaccard(t, edited), r["near_next"] - jaccard(t, after)]
        if t == after:
            assert r["near_next"] == 1.0
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.06
    same = {}
    for t, i in zip(texts, ids):
        assert same.setdefault(t or "", got[i]["fingerprint"]) == got[i]["fingerprint"]


def test_fingerprint_edges(table):
    assert cws.fingerprint(table(["a"]).where("false")).count() == 0
    one = cws.fingerprint(table(["a b c d"])).first()
    assert one["near_next"] == 1.0
    got = cws.fingerprint(table(["p q", "p q", "r", None], [None, 7, 7, 7], parts=2)).collect()
    assert len(got) == 4 and {r["n_chars"] for r in got} == {3, 1, 0}


def test_samples_collide_like_generalised_jaccard():
    sampler = cws.Sampler(4096)
    a, b = "x x x x y z", "x x y y z w"
    sig = sampler.signatures([a, b, a])
    assert (sig[0] == sig[2]).all() and (sig[0] == sig[1]).mean() == pytest.approx(jaccard(a, b), abs=0.03)


SCHEMA = {"get": {"type": "object", "properties": {"n": {"type": "integer"}, "kind": {"enum": ["a", "b"]}}, "required": ["n"], "additionalProperties": False}}


def call(i, **arguments):
    return f'<tool_call>{json.dumps({"name": "get", "id": i, "arguments": arguments})}</tool_call>'


@pytest.fixture
def chats(spark):
    rows = [
        (1, 0, "user", "hi \"there\" é"), (1, 1, "assistant", "sure " + call("c1", n=1) + call("c2", n="x", z=1)), (1, 2, "tool", '{"tool_call_id": "c2", "value": {"b": 1, "a": 2}}'),
        (1, 3, "tool", '{"tool_call_id": "c1", "value": 3}'), (1, 4, "assistant", "done"), (2, 0, "tool", '{"id": "late", "v": 1}'), (2, 1, "assistant", call("late", n=2, kind="b")),
        (2, 2, "assistant", call("never", n=1) + "<tool_call>not json</tool_call>"), (2, 3, "tool", "plain"), (None, None, None, None), (3, 0, "user", "twice"), (3, 0, "user", "twice"),
    ]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("message", F.lit("clash"))


def test_calls_are_linked_ordered_and_checked(chats):
    got = chat.format_chats(chats, SCHEMA).collect()
    assert len(got) == 12
    one = sorted((r for r in got if r["conv_id"] == 1), key=lambda r: (r["turn"], r["place"], r["role"]))
    made = json.loads(one[1]["message"])
    assert made["content"] == "sure " and [c["id"] for c in made["tool_calls"]] == ["c1", "c2"]
    assert "fault" not in made["tool_calls"][0] and made["tool_calls"][1]["fault"] == "$.n: not integer; $.z: unknown"
    assert (one[1]["n_calls"], one[1]["n_linked"]) == (2, 2)
    assert '"content":{"tool_call_id":"c2","value":{"a":2,"b":1}}' in one[2]["message"] and json.loads(one[0]["message"])["content"] == 'hi "there" é'
    two = [json.loads(r["message"]) for r in sorted((r for r in got if r["conv_id"] == 2), key=lambda r: (r["turn"], r["place"], r["role"]))]
    assert two[0]["tool_calls"][0]["fault"] == "result before call" and two[1]["tool_call_id"] == "late"
    assert [c["fault"] for c in two[2]["tool_calls"]] == ["no result", "not JSON; no result"] and two[3]["fault"] == "not JSON; no call"
    assert [r["turn"] for r in got if r["conv_id"] is None] == [None]
    for r in got:
        value = json.loads(r["message"])
        assert list(value) == sorted(value)


def test_whole_chats_and_empty(chats):
    whole = {r["conv_id"]: json.loads(r["messages"]) for r in chat.whole_chats(chat.format_chats(chats, SCHEMA)).collect()}
    assert [m["role"] for m in whole[1]] == ["user", "assistant", "tool", "tool", "assistant"] and len(whole[3]) == 2
    assert chat.format_chats(chats.where("false"), SCHEMA).count() == 0


def test_schema_faults():
    assert chat.faults({"n": True}, SCHEMA["get"]) == ["$.n: not integer"]
    assert chat.faults([1, "a"], {"type": "array", "items": {"type": ["integer", "null"]}}) == ["$[1]: not integer/null"]
    assert chat.canonical({"b": "é", "a": [1, {"d": None, "c": 2.5}]}) == '{"a":[1,{"c":2.5,"d":null}],"b":"é"}'


def test_pipeline_stages_against_brute_force(spark, table, store):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts = [" ".join(rng.choice(vocabulary, 60)) + "\n" + " ".join(rng.choice(vocabulary, 20)) for _ in range(120)]
    shared = "this very line is repeated in a good many of all these documents here"
    texts = [t + f"\n{shared}" if i % 4 == 0 else t for i, t in enumerate(texts)]
    texts += [t.replace("\n", " end\n", 1) for t in texts[:10]] + texts[10:13] + ["grunk grunk snorble " + texts[20][:80] for _ in range(3)]
    bad = [f"{texts[i]} grunk snorble grunk" for i in range(30, 90)]
    d = store(table(texts + bad, sources=[f"s{i % 3}" for i in range(len(texts + bad))]), labels=spark.createDataFrame([(i, 1, int(i >= len(texts))) for i in range(len(texts + bad))], "doc_id long, quality int, toxic int"))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.checkpoint(stage(spark, docs, d))
        seen.append((name, before, docs))
    for name, before, after in seen[:-1]:
        assert sorted(after.columns) == sorted(corpus_pipeline.COLUMNS), name
    rows = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    _, before, after = seen[0]
    assert set(rows(after)) >= {i for i in range(len(texts) - 3)} and len(set(rows(after)) & set(range(len(texts), len(texts + bad)))) <= 2
    _, before, after = seen[1]
    b, a = rows(before), rows(after)
    holders = [i for i, t in b.items() if shared in t.split("\n")]
    assert all((shared in a[i].split("\n")) == (i == max(holders)) for i in holders) and set(a) == set(b)
    assert {r["doc_id"]: r["n_chars"] for r in after.collect()} == {i: len(t) for i, t in a.items()}
    _, before, after = seen[2]
    b = sorted(rows(before).items())
    firsts = {b[g][0] for g in brute_groups([t for _, t in b])}
    assert set(rows(after)) == firsts and after.count() == len(firsts) < len(b)
    _, before, after = seen[3]
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(before.withColumn("size", mixing.size_of("text"))).collect() if r["copies"]}
    assert dict(Counter(r["doc_id"] for r in after.collect())) == want
    _, before, after = seen[4]
    assert after.count() == before.count() and after.where("decodes").count() == after.count()
    assert corpus_pipeline.run(spark, d).count() == after.count()


def test_stages_with_odd_rows(spark, table, store):
    d = store(table(["a"]), labels=spark.createDataFrame([(None, None, None), (1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int"))
    odd = table([None, "", "x y", "x y", None], [None, 1, 2, 2, 3]).withColumn("size", F.lit("clash"))
    for stage in (corpus_pipeline.drop_lines, corpus_pipeline.drop_near_copies, corpus_pipeline.mix_sources, corpus_pipeline.drop_toxic):
        got = stage(spark, odd, d)
        assert got.columns == corpus_pipeline.COLUMNS and got.count() <= 15 and stage(spark, odd.where("false"), d).count() == 0
    assert corpus_pipeline.drop_near_copies(spark, odd, d).count() == 2
    assert lines.apply_bitmaps(odd, lines.line_bitmaps(odd)).where("text is null").count() == 2
