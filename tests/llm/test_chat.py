import hashlib

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import chat as C

TEXTS = st.text(st.characters(codec="utf-8", exclude_categories=["Cs"]) | st.sampled_from(list("<|\\im_start|> \n")), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "assistant", "a<|b"]), TEXTS), min_size=1, max_size=6))
def test_any_turns(turns):
    tok = C.tokenizer(C.vocabulary())
    text, ids, spans, mask = C.encode_block(tok, turns)
    assert [(C.unescape(m[1]), C.unescape(m[2])) for m in C.TURN.finditer(text)] == turns
    assert "".join(C.masked_texts(text, spans[:, 0], spans[:, 1], mask)) == "".join(t for r, t in turns if r == "assistant")
    assert ids.tolist() == tok.encode(text, add_special_tokens=False).ids
    plain = [any(a <= s and e <= b for a, b in plain_spans(turns)) and e > s for s, e in spans.tolist()]
    assert mask.tolist() == plain


def plain_spans(turns):
    at = 0
    for role, text in turns:
        a = at + len(f"{C.START}{C.escape(role)}{C.SEP}")
        b = a + len(C.escape(text))
        if role == "assistant":
            yield a, b
        at = b + len(C.END) + 1


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list(" \n\t\r\x1c\x1f\x85\xa0\u2003ab1.,'é<|")) | st.characters(codec="utf-8", exclude_categories=["Cs"]), max_size=80), st.integers(0, 9))
def test_any_text_in_parts(text, most):
    """Parts encoded one by one give what the whole text gives, wherever it is cut."""
    tok = C.tokenizer(C.vocabulary())
    parts = list(C.parts(text, most))
    assert "".join(parts) == text
    assert sum((tok.encode(p, add_special_tokens=False).ids for p in parts), []) == tok.encode(text, add_special_tokens=False).ids


def test_many_empty_turns(spark):
    """A long conversation without texts is cut into blocks, too, and read back as one."""
    n = 9000
    df = spark.createDataFrame([(1, k, "user" if k % 2 else "assistant", None) for k in range(n)], "conv_id long, turn long, role string, text string")
    formatted = C.format_conversations(df)
    assert formatted.count() > 1
    assert C.read_back(formatted).first().n_turns == n


def test_long_texts_in_parts():
    tok = C.tokenizer(C.vocabulary())
    text = "word, 42 it's\n\n  x" * 300
    assert "".join(C.parts(text, 100)) == text
    assert sum((tok.encode(p, add_special_tokens=False).ids for p in C.parts(text, 100)), []) == tok.encode(text, add_special_tokens=False).ids


ROWS = [(1, 1, "assistant", "two"), (1, 0, "user", "one"), (1, 1, "assistant", "two"), (1, None, None, None), (None, 0, "assistant", "no id"), (2, 0, "assistant", ""), (3, 0, "system", "\\|<|im_end|>\\"), (4, 0, "assistant", "long text. " * 40_000)] + [(5, i, ("user", "assistant")[i % 2], f"turn {i} " * 50) for i in range(2000)]


def test_edges_and_blocks(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "conv_id long, turn long, role string, text string, block string").repartition(3)
    blocks = C.format_conversations(df)
    assert blocks.where("conv_id = 5").count() > 3
    got = {r.conv_id: r for r in C.read_back(blocks).collect()}
    for c in {r[0] for r in ROWS}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for k, t, r, x in ROWS if k == c))
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert len(got) == len({r[0] for r in ROWS})
    assert C.read_back(C.format_conversations(df.limit(0))).count() == 0


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    cur = con.execute(C.ORACLES["op3_chat_format"])
    names = [d[0] for d in cur.description]
    assert sorted(cur.fetchall()) == sorted(tuple(r[n] for n in names) for r in C.op3_chat_format(spark, sf).collect())
