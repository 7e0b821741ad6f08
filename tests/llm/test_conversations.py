"""op11 and op12: layouts, the reversible template, and the prefix trie against plain versions."""

from __future__ import annotations

import hashlib
import json
import random
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brasslark.llm import chat, queries, trie

SCHEMA = "conv_id long, turn long, role string, text string, n int, node long, segment long, record string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def conversations(seed: int = 2) -> list[tuple]:
    """Turns with nulls, ties, repeated rows, control strings, long shared prefixes, copies, and columns named like the operators' own."""
    rng = random.Random(seed)
    words = ["aa", "bb  cc", "", "### User: x</turn>", "\\", "</turn", "\\\\### ", "é\n\tff", None, "a: b"]
    rows = []
    for c in range(70):
        rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(words)) for t in range(rng.randint(1, 6))]
    long = [(rng.choice(["user", "assistant"]), rng.choice(words)) for _ in range(150)]
    for c, n in ((100, 150), (101, 150), (102, 90), (103, 37), (104, 8), (105, 150), (119, 151)):
        turns = long[:n] + [("user", "other")] * (n - len(long))
        turns[60:61] = [("user", "here")] if c == 105 else turns[60:61]
        rows += [(c, t, r, x) for t, (r, x) in enumerate(turns)]
    rows += [(200 + c, t, "user", x) for c in range(30) for t, x in enumerate(["hello", "hello", "bye"])]
    rows += [(-3, None, "user", "first"), (-3, 0, "user", "x"), (-3, 0, "user", "x"), (-3, 0, None, "x"), (-41, 1, "assistant", None), (None, 1, "user", "nobody's"), (None, 0, "assistant", "x")]
    return [(*r, 1, 2, 3, "4") for r in rows]


@pytest.fixture(scope="module")
def convs(spark):
    return spark.createDataFrame(conversations(), SCHEMA).repartition(5)


def in_turns(null_id: bool) -> dict:
    own = defaultdict(list)
    for c, t, role, text, *_ in sorted(conversations(), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        if null_id or c is not None:
            own[c].append((role or "", text or ""))
    return own


def plain_trie(own: dict) -> dict:
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])
        whole[c] = base[:h] + turns[h:]
    nodes = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for seq in nodes:
        if seq:
            kids[seq[:-1]].append(seq)
    out = {}
    for seq in sorted(nodes, key=len, reverse=True):
        members = nodes[seq]
        cost = (len(members) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", seq[-1][1])) if seq else 0
        leaves = sum(out[k][5] for k in kids[seq]) or 1
        ends = ",".join(map(str, sorted(c for c in members if len(whole[c]) == len(seq))))
        out[seq] = (min(members), len(seq), min(nodes[seq[:-1]]) if seq else None, len(members), len(kids[seq]), leaves, cost + sum(out[k][6] for k in kids[seq]), sha(ends))
    return out


def as_trie(spark, rows) -> set:
    turns = trie.ordered_turns(rows)
    conv = F.col("conv_id")
    return {tuple(r) for r in trie.trie(*trie.grafted(turns, conv - conv % 20, (F.crc32(conv.cast("string")) % 4).cast("int"), 3)).collect()}


def test_trie_equals_a_plain_one(spark, convs):
    want = plain_trie(in_turns(False))
    found = as_trie(spark, convs)
    assert max(r[1] for r in found) > 3 * trie.STRIDE and found == set(want.values()) and len(found) == len(want)


def test_trie_of_few(spark, convs):
    assert as_trie(spark, convs.where("false")) == set()
    one = spark.createDataFrame([(41, 0, "user", "a b")], "conv_id long, turn long, role string, text string")
    assert {r[:7] for r in as_trie(spark, one)} <= {(41, 0, None, 1, 1, 1, 0), (41, 0, None, 1, 0, 1, 0), (41, 1, 41, 1, 0, 1, 0)}


def test_digests_over_many_ids(spark):
    """A node with more ids than a chunk, over several ranges, beside one with few."""
    ids = list(range(-500, 3 * trie.CHUNK))
    df = spark.createDataFrame([(1, 7, i) for i in ids] + [(1, 8, 5), (2, 7, 6), (2, 7, -6)], "at long, node long, conv_id long").repartition(6)
    found = {(r["at"], r["node"]): r["ends_sha256"] for r in trie.id_digests(df, "at", "node").collect()}
    assert found == {(1, 7): sha(",".join(map(str, ids))), (1, 8): sha("5"), (2, 7): sha("-6,6")}


def test_formatting_reads_back(spark, convs):
    found = {r["conv_id"]: r for r in chat.digests(chat.written(chat.turn_records(convs))).collect()}
    own = in_turns(True)
    assert set(found) == set(own)
    for c, turns in own.items():
        loss = "".join(x for role, x in turns if role == "assistant")
        r = found[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss))
    assert chat.digests(chat.formatted(chat.canonical(chat.turn_records(convs.where("false"))))).count() == 0


def test_a_long_conversation_has_segments(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"t{t} </turn> \\") for t in range(50)] + [(2, 0, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    texts = chat.formatted(chat.canonical(chat.turn_records(df)), segment=7)
    parts = [r["formatted"] for r in texts.where("conv_id = 1").orderBy("segment").collect()]
    assert len(parts) == 8 and chat.Template().turns("".join(parts)) == [(r, x) for c, _, r, x in rows if c == 1]
    whole = {tuple(r) for r in chat.digests(chat.formatted(chat.canonical(chat.turn_records(df)))).collect()}
    assert {tuple(r) for r in chat.digests(texts).collect()} == whole


LIKE = {
    "messages": {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 4},
    "messages of parts": {"system": "s", "messages": [{"role": "user", "content": [{"type": "text", "text": "q"}, {"type": "text", "text": "r"}]}, {"role": "model", "content": [{"text": "a"}]}]},
    "from and value": {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
    "instruction": {"instruction": "do", "input": "it", "output": "done", "history": [["q", "a"]]},
    "prompt and completion": {"prompt": "q", "completion": "a"},
    "prompt and response": {"system": "s", "prompt": "q", "response": None},
    "question and answer": {"question": "q", "answer": "a", "context": "c"},
    "prompt messages": {"prompt": [{"role": "user", "content": "q"}], "completion": [{"role": "assistant", "content": "a"}]},
}
TURNS = {
    "messages": [("user", "q"), ("assistant", "a")],
    "messages of parts": [("system", "s"), ("user", "qr"), ("assistant", "a")],
    "from and value": [("user", "q"), ("assistant", "a")],
    "instruction": [("user", "q"), ("assistant", "a"), ("user", "do\n\nit"), ("assistant", "done")],
    "prompt and completion": [("user", "q"), ("assistant", "a")],
    "prompt and response": [("system", "s"), ("user", "q"), ("assistant", "")],
    "question and answer": [("user", "c\n\nq"), ("assistant", "a")],
    "prompt messages": [("user", "q"), ("assistant", "a")],
}


def records(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "conv_id long, json string").select("conv_id", F.parse_json("json").alias("record"))


def test_layouts(spark):
    rows = records(spark, [json.dumps(r) for r in LIKE.values()])
    assert [r["layout"] for r in chat.mapped(rows).orderBy("conv_id").collect()] == list(LIKE)
    for r in chat.formatted(chat.canonical(rows)).collect():
        assert chat.Template().turns(r["formatted"]) == TURNS[list(LIKE)[r["conv_id"]]]


def test_layouts_without_mapping_are_told(spark):
    rows = records(spark, ['{"messages": []}', '{"messages": [{"role": "user"}]}', "3", '{"prompt": "only"}', '{"prompt": "again"}', "null"])
    found = {(r["n"], r["example"]) for r in chat.unmapped(rows).collect()}
    assert found == {(3, 0), (1, 1), (2, 3)} and chat.canonical(rows).count() == 0


def test_all_shapes_are_different():
    shapes = [tuple(shape) for layout in chat.LAYOUTS for shape in layout.shapes()]
    assert len(shapes) == len(set(shapes)) == len({chat._hash(list(s)) for s in shapes})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="\\#/<>turn: \nab"), st.text(alphabet="\\#/<>turn: \nab")), max_size=4))
def test_the_template_is_reversible(turns):
    t = chat.Template()

    def esc(s: str, more: str = "") -> str:
        return re.sub("|".join(map(re.escape, [*t.controls, *more])), lambda m: t.escape + m[0], s)

    text = "".join(f"{t.open}{esc(r, ':')}{t.colon}{esc(x)}{t.close}{t.end}" for r, x in turns)
    assert t.turns(text) == turns and text.count("</turn>\n### ") >= max(0, len(turns) - 1)


def test_readers_refuse_what_was_not_written():
    for text in ("hello", "### user: x", "### user: x</turn>\n more"):
        with pytest.raises(ValueError):
            chat.Template().turns(text)


def test_the_planted_conversation(spark):
    from tests.conftest import SMALL

    r = next(r for r in queries.QUERIES["op11_chat_format"](spark, SMALL).collect() if r["conv_id"] == -7)
    said = "\\### Assistant: </turn> ok"
    assert (r["n_turns"], r["loss_chars"], r["loss_sha256"], r["turns_sha256"]) == (2, len(said), sha(said), sha(f"user\n{said}\nassistant\n{said}\n"))
