"""Chat formatting with token loss masks aligned by character offsets."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
# The template's control strings. No escaped text holds "###" or "</".
HEADS = {"system": "### System:", "user": "### User:", "assistant": "### Assistant:"}
OTHER, NAMED, END = "### Role:", "</role>", "</turn>"
CONTROL = [*HEADS.values(), OTHER, NAMED, END]
HEAD = re.compile("|".join(map(re.escape, [*HEADS.values(), OTHER])))
PIECE_CHARS = 1 << 19


def escape(text: str) -> str:
    r"""Backslashes are doubled; one stands inside each "##" and each "</"."""
    return re.sub(r"\\|##|</", lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1]}", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[tuple[str, str]], trained: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The turns in the template, and the [start, end) spans of the trained role's texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = HEADS.get(role) or OTHER + escape(role) + NAMED
        body = escape(text)
        if role == trained:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered text."""
    names = {v: k for k, v in HEADS.items()}
    turns, at = [], 0
    while at < len(formatted):
        head = HEAD.match(formatted, at)
        if not head:
            raise ValueError(f"no turn at {at}")
        at, role = head.end(), names.get(head.group())
        if role is None:
            end = formatted.index(NAMED, at)
            role, at = unescape(formatted[at:end]), end + len(NAMED)
        end = formatted.index(END, at)
        turns.append((role, unescape(formatted[at:end])))
        at = end + len(END)
    return turns


def tokenizer(vocabulary: str):
    """The public vocabulary with the control strings as single tokens, so no token crosses a turn's edge."""
    from tokenizers import AddedToken, Tokenizer, processors

    t = Tokenizer.from_file(vocabulary)
    t.add_special_tokens([AddedToken(c, normalized=False, special=True) for c in CONTROL])
    t.post_processor = processors.ByteLevel(trim_offsets=False)
    return t


def loss_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """True for the tokens (start, end) inside one of the sorted spans, by binary search."""
    if not len(spans) or not len(offsets):
        return np.zeros(len(offsets), bool)
    starts, ends = np.array(spans).T
    at = np.searchsorted(starts, offsets[:, 0], side="right") - 1
    return (at >= 0) & (offsets[:, 1] <= ends[np.maximum(at, 0)]) & (offsets[:, 0] < offsets[:, 1])


def masked_text(formatted: str, offsets: np.ndarray, mask: np.ndarray) -> str:
    """The formatted text under the mask, still escaped; bytes of one character share its offsets."""
    out, last = [], 0
    for a, b in offsets[mask].tolist():
        a = max(a, last)
        if b > a:
            out.append(formatted[a:b])
            last = b
    return "".join(out)


class Conversation:
    """Running digests of one conversation, read back from its formatted pieces."""

    def __init__(self, conv_id, encode, emit: str):
        self.conv_id, self.encode, self.emit = conv_id, encode, emit
        self.turns: list[tuple[str, str]] = []
        self.size = self.n_turns = self.loss_chars = self.formatted_chars = self.piece = 0
        self.seen, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, role: str, text: str) -> Iterator[dict]:
        self.turns.append((role, text))
        self.size += len(text)
        if self.size > PIECE_CHARS:
            yield from self.flush()

    def flush(self) -> Iterator[dict]:
        if not self.turns:
            return
        formatted, spans = render(self.turns)
        encoded = self.encode(formatted)
        offsets = np.array(encoded.offsets, dtype=np.int64).reshape(-1, 2)
        mask = loss_mask(offsets, spans)
        if self.emit == "tokens":
            yield {"conv_id": self.conv_id, "piece": self.piece, "formatted": formatted, "ids": encoded.ids, "loss": mask.tolist()}
        for role, text in parse(formatted):
            self.seen.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
        lost = unescape(masked_text(formatted, offsets, mask))
        self.loss.update(lost.encode())
        self.loss_chars += len(lost)
        self.formatted_chars += len(formatted)
        self.piece += 1
        self.turns, self.size = [], 0

    def close(self) -> Iterator[dict]:
        yield from self.flush()
        if self.emit == "digest":
            yield {
                "conv_id": self.conv_id, "n_turns": self.n_turns, "turns_sha256": self.seen.hexdigest(), "loss_chars": self.loss_chars,
                "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.formatted_chars,
            }


SCHEMAS = {
    "digest": "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    "tokens": "conv_id long, piece int, formatted string, ids array<int>, loss array<boolean>",
}


def format_conversations(rows: DataFrame, emit: str = "digest", vocabulary: str = VOCABULARY) -> DataFrame:
    """Format whole conversations; ``emit`` 'tokens' gives texts, token ids and masks, 'digest' what reading them back gives.

    Rows are dealt by conv_id and sorted by turn (then role and text; nulls first),
    and each task reads its conversations as a stream: a very long one is encoded in
    pieces cut between turns, where no token can cross, so memory stays bounded.
    Null texts and roles are empty; rows with a null conv_id form one conversation.
    An empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(vocabulary).encode
        names = [c.split()[0] for c in SCHEMAS[emit].split(", ")]
        now, key = None, object()
        for b in batches:
            out: list[dict] = []
            for conv, role, text in zip(b["conv_id"], b["role"], b["text"], strict=True):
                conv = None if pd.isna(conv) else int(conv)
                if conv != key or now is None:
                    if now is not None:
                        out += now.close()
                    now, key = Conversation(conv, encode, emit), conv
                out += now.add(role, text)
            if out:
                yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
        if now is not None and (out := list(now.close())):
            yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    clean = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    dealt = clean.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInPandas(run, SCHEMAS[emit])
