"""Chat formatting with loss masks aligned by offsets.

A conversation is rendered as a whole, encoded once, and the encoder's offsets tell which characters each token
stands for. The turns' texts are sorted spans of the rendered string, as the tokens are, so the tokens of a span are
found by binary search, and each is trained if it meets the span of an assistant's text.

Template, for each turn: <|turn|> role <|text|> text <|end|>. The three marks are special tokens, so no token ever
holds characters of both a mark and a text. In roles and texts a backslash becomes two, and each control string gets
a backslash after its first character; a backslash and any character then read back as that character.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss.llm.common import by_bytes

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that chat formats give a meaning; `<|` begins all marks of its kind, ours included.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The string, and a row (begin, end) of its text for each turn, in characters."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        parts += [head, body, END]
        spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


_MARKS = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.DOTALL)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns again. Marks can't occur in escaped roles or texts, so the first one met is the right one."""
    return [(unescape(m[1]), unescape(m[2])) for m in _MARKS.finditer(formatted)]


@functools.cache
def encoder(described: str):
    """The encoder that a vocabulary file's contents describe, with our marks."""
    from tokenizers import AddedToken, Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    t = Tokenizer.from_str(described)
    t.pre_tokenizer = ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=True)
    t.add_special_tokens([AddedToken(x, special=True, normalized=False) for x in (TURN, TEXT, END)])
    return t


def loss_mask(offsets: np.ndarray, spans: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(mask by token, the characters that the masked tokens cover inside trained spans, as merged stretches)."""
    mask = np.zeros(len(offsets), bool)
    covered: list[tuple[int, int]] = []
    first = np.searchsorted(offsets[:, 1], spans[:, 0], "right")
    last = np.searchsorted(offsets[:, 0], spans[:, 1], "left")
    for (begin, end), a, b, wanted in zip(spans.tolist(), first.tolist(), last.tolist(), trained.tolist()):
        if not wanted or a >= b or begin == end:
            continue
        mask[a:b] = True
        low = np.maximum(offsets[a:b, 0], begin)
        high = np.minimum(np.maximum.accumulate(offsets[a:b, 1]), end)
        breaks = np.flatnonzero(low[1:] > high[:-1]) + 1  # characters that no token stands for
        covered += zip(low[np.append(0, breaks)].tolist(), high[np.append(breaks - 1, len(high) - 1)].tolist())
    return mask, covered


def format_chats(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tokenizer: str = TOKENIZER, train: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_col, formatted, n_turns, token_ids, loss_mask (by token), loss_spans (characters of formatted: begin, end, ...).

    Rows of a conversation go by turn, then role, then text (nulls first), so ties and repeated rows have one order;
    repeated rows are turns like others. Null roles and texts are empty; rows with a null conversation are one
    conversation. Extra columns are not read. An empty table gives no rows. A conversation is one output row, and so
    must fit a task's memory; nothing else of the table must.
    """
    kind = conversations.schema[conv_col].dataType.simpleString()
    rows = conversations.select(F.col(conv_col).alias("conv"), F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")).alias("x"))
    grouped = rows.groupBy("conv").agg(F.sort_array(F.collect_list("x")).alias("turns"))
    grouped = grouped.select("conv", F.transform("turns", lambda x: F.coalesce(x["role"], F.lit(""))).alias("roles"), F.transform("turns", lambda x: F.coalesce(x["text"], F.lit(""))).alias("texts"))

    with open(tokenizer, encoding="utf-8") as file:  # on the driver; of a vocabulary's fixed size
        sent = conversations.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(sent.value)
        for batch in batches:
            roles, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            rendered = [render(list(zip(r, t))) for r, t in zip(roles, texts)]
            for a, b in by_bytes([x for x, _ in rendered], 1 << 20):
                ids, masks, spans = [], [], []
                for (_, places), names, found in zip(rendered[a:b], roles[a:b], encode.encode_batch([x for x, _ in rendered[a:b]], add_special_tokens=False)):
                    offsets = np.fromiter(chain.from_iterable(found.offsets), np.int64, 2 * len(found)).reshape(-1, 2)
                    mask, covered = loss_mask(offsets, places, np.array([n in train for n in names], bool))
                    ids.append(pa.array(found.ids, pa.int32()))
                    masks.append(pa.array(mask))
                    spans.append([x for span in covered for x in span])
                sizes = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([x for x, _ in rendered[a:b]], pa.string()),
                        pa.array([len(x) for x in roles[a:b]], pa.int64()),
                        pa.ListArray.from_arrays(sizes, pa.concat_arrays(ids)),
                        pa.ListArray.from_arrays(sizes, pa.concat_arrays(masks)),
                        pa.array(spans, pa.list_(pa.int32())),
                    ],
                    names=["conv", "formatted", "n_turns", "token_ids", "loss_mask", "loss_spans"],
                )

    out = grouped.mapInArrow(run, f"conv {kind}, formatted string, n_turns long, token_ids array<int>, loss_mask array<boolean>, loss_spans array<int>")
    return out.withColumnRenamed("conv", conv_col)


def digests(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What can be read back from format_chats' rows: turns, and the text under the loss mask."""
    kind = formatted.schema[conv_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, turns, chars, loss, length = [], [], [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found = parse(text)
                n.append(len(found))
                turns.append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in found).encode()).hexdigest())
                under = unescape("".join(text[b:e] for b, e in zip(spans[::2], spans[1::2])))
                chars.append(len(under))
                loss.append(hashlib.sha256(under.encode()).hexdigest())
                length.append(len(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(turns, pa.string()), pa.array(chars, pa.int64()), pa.array(loss, pa.string()), pa.array(length, pa.int64())],
                names=["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    out = formatted.select(conv_col, "formatted", "loss_spans").mapInArrow(run, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumnRenamed("conv", conv_col)
