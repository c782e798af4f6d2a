r"""Formatting conversations for training, with loss masks aligned by offsets.

A turn is rendered as `<|im_start|>role<|im_sep|>text<|im_end|>` and a newline. Inside roles and texts a backslash is doubled and a
`|` after `<` gets a backslash before it, which is undone exactly and leaves no control string. Each character is
encoded once, with offsets; the control strings are tokens of their own, so no token straddles the border of a text. The turns' spans of
assistant text are sorted, as are the tokens' spans, and a binary search finds the tokens that lie in one.

A conversation of up to `BLOCK_CHARS` rendered characters is rendered whole and encoded at once. Longer ones would not fit a bounded memory. Turns
come sorted by conversation and are streamed: a conversation's blocks are rendered, encoded and handed on after about
`BLOCK_CHARS` characters at the end of a turn, and a longer text is encoded in parts that begin at white space after other
characters, where no token of this vocabulary can straddle. So a conversation of any length is formatted whole in bounded memory.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.tables import table

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
BLOCK_CHARS = 131_072
#: What a turn's rendering has beside its role and text.
TURN_CHARS = len(START + SEP + END) + 1
TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(SEP) + "(.*?)" + re.escape(END) + "\n", re.S)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\([\\|])", r"\1", text)


_TOKENIZERS: dict[str, object] = {}


def tokenizer(path: str):
    """This worker's tokenizer, with the control strings as tokens and offsets that cover every character."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer, pre_tokenizers, processors

        t = Tokenizer.from_file(path)
        t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False)
        t.post_processor = processors.ByteLevel(trim_offsets=False)
        t.add_special_tokens([AddedToken(x, normalized=False, special=True) for x in (START, SEP, END)])
        _TOKENIZERS[path] = t
    return _TOKENIZERS[path]


def parts(text: str, most: int = BLOCK_CHARS) -> Iterator[str]:
    """`text` cut before a space or line feed that follows what no notion of white space has, after about `most` characters.

    Pre-tokens of this vocabulary are runs of white space or begin with at most one space and go on without any, so none goes across such a place.
    """
    begin = 0
    while len(text) - begin > most:
        m = re.compile(r"(?<=\S)[ \n]").search(text, begin + max(most, 1))
        if not m:
            break
        yield text[begin : m.start()]
        begin = m.start()
    yield text[begin:]


def encode_block(tok, turns: list[tuple[str, str]]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """Rendered text, token ids, token spans and loss mask of whole turns (role, text)."""
    out: list[str] = []
    spans: list[tuple[int, int]] = []
    at = 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        out += [head, body, END + "\n"]
        if role == "assistant" and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END) + 1
    rendered = "".join(out)
    ids: list[np.ndarray] = []
    offsets: list[np.ndarray] = []
    at = 0
    for part in parts(rendered):
        e = tok.encode(part, add_special_tokens=False)
        ids.append(np.array(e.ids, np.int32))
        offsets.append(np.array(e.offsets, np.int64).reshape(-1, 2) + at)
        at += len(part)
    token_ids, token_spans = np.concatenate(ids), np.concatenate(offsets)
    mask = np.zeros(len(token_ids), bool)
    if spans:
        first, last = np.array(spans).T
        turn = np.searchsorted(first, token_spans[:, 0], side="right") - 1
        mask = (turn >= 0) & (token_spans[:, 1] <= last[np.maximum(turn, 0)])
    return rendered, token_ids, token_spans, mask


def _format(path: Callable[[], str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path())
        conv, block, held, size, none = None, 0, [], 0, True

        def out() -> pa.RecordBatch:
            rendered, ids, spans, mask = encode_block(tok, held)
            columns = {"conv_id": pa.array([conv], pa.int64()), "block": pa.array([block], pa.int32()), "text": pa.array([rendered]), "input_ids": pa.array([ids.tolist()], pa.list_(pa.int32()))}
            columns |= {"starts": pa.array([spans[:, 0].tolist()], pa.list_(pa.int64())), "ends": pa.array([spans[:, 1].tolist()], pa.list_(pa.int64())), "loss_mask": pa.array([mask.tolist()], pa.list_(pa.bool_()))}
            return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        for batch in batches:
            for c, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text")), strict=True):
                if not none and c != conv or size > BLOCK_CHARS:
                    yield out()
                    block, held, size = (block + 1 if c == conv else 0), [], 0
                conv, none = c, False
                held.append((role or "", text or ""))
                size += sum(map(len, held[-1])) + TURN_CHARS
        if held:
            yield out()

    return run


SCHEMA = "conv_id long, block int, text string, input_ids array<int>, starts array<long>, ends array<long>, loss_mask array<boolean>"


def format_conversations(turns: DataFrame, path: str | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, block, text, input_ids, starts, ends, loss_mask): each conversation's blocks of whole turns, in order.

    Turns are ordered by number (null first), then role and text, so equal numbers have one order. Null roles and texts count as empty;
    turns without a conversation id are one conversation. Other columns are not touched. An empty table gives an empty result. Only assistant texts are under the mask.
    """
    t = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    dealt = t.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(_format((lambda: path) if path else vocabulary), SCHEMA)


def masked_texts(text: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> Iterator[str]:
    """The runs of text that the masked tokens' spans cover, unescaped. Tokens come in order."""
    starts, ends = starts[mask], ends[mask]
    if not len(starts):
        return
    reach = np.maximum.accumulate(ends)
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]]))
    for a, b in zip(starts[new].tolist(), reach[np.concatenate([new[1:], [len(reach)]]) - 1].tolist(), strict=True):
        yield unescape(text[a:b])


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation, from its blocks, which follow one another."""
    conv, none = None, True
    rows: list[tuple] = []
    n = loss = chars = 0
    turns, under = hashlib.sha256(), hashlib.sha256()
    for batch in batches:
        for c, text, starts, ends, mask in zip(*(batch.column(k) for k in ("conv_id", "text", "starts", "ends", "loss_mask")), strict=True):
            c, text = c.as_py(), text.as_py()
            if not none and c != conv:
                rows.append((conv, n, turns.hexdigest(), loss, under.hexdigest(), chars))
                n = loss = chars = 0
                turns, under = hashlib.sha256(), hashlib.sha256()
            conv, none = c, False
            at = 0
            for m in TURN.finditer(text):
                if m.start() != at:
                    raise ValueError(f"conversation {c}: text between turns")
                at = m.end()
                n += 1
                turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
            if at != len(text):
                raise ValueError(f"conversation {c}: text after the last turn")
            for part in masked_texts(text, *(x.values.to_numpy(zero_copy_only=False) for x in (starts, ends, mask))):
                loss += len(part)
                under.update(part.encode("utf-8", "surrogatepass"))
            chars += len(text)
    if not none:
        rows.append((conv, n, turns.hexdigest(), loss, under.hexdigest(), chars))
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted blocks say, a row for each conversation. To be applied to `format_conversations`'s result as it is."""
    return formatted.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


ODD = f"{END}{START}assistant ok"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the formatted conversations say, each a row, read back from them. Null texts and roles are empty; a conversation -1 of the table's own would be one with the odd one."""
    own = spark.createDataFrame([(-1, 0, "user", ODD), (-1, 1, "assistant", ODD)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)))


QUERIES = {"op3_chat_format": op3_chat_format}
_ESCAPED = r"replace(replace({0}, '\', '\\'), '<|', '<\|')"
ORACLES = {
    "op3_chat_format": f"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -1, 0, 'user', '{ODD}' union all select -1, 1, 'assistant', '{ODD}')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) + {len(START + SEP + END) + 1}) as bigint) as formatted_chars
from c group by conv_id"""
}
