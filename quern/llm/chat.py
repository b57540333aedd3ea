"""Op 5: chat formatting by token-level assembly.

Each turn's text is encoded by itself; control ids, reserved beyond the vocabulary, are spliced between; the loss mask is the prefix sum
of +1 where an assistant's text begins and -1 where it ends. A text can never encode to a reserved id, and control strings inside a text
are escaped by one backslash after their first character, so that the rendered string can be read back as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.bpe import byte_symbols
from quern.llm.scratch import bound_batches

#: Control strings of the template, in the order of their reserved ids. A role without a mark of its own gets [ROLE] and its name.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ASST]", "[/ASST]", "[ROLE]", "[/ROLE]", "[NAME]"]
MARKS = {"user": ("[INST]", "[/INST]"), "system": ("[SYS]", "[/SYS]"), "assistant": ("[ASST]", "[/ASST]")}
_OTHER = ("[ROLE]", "[/ROLE]")
_TAILS = "|".join(regex.escape(c[1:]) for c in CONTROLS)
_ESCAPE = regex.compile(rf"([<\[])(\\*)(?={_TAILS})")
_UNESCAPE = regex.compile(rf"([<\[])\\(\\*)(?={_TAILS})")


def escape(text: str) -> str:
    """No control string stands in the result; unescape() gives the text back, whatever it was."""
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


class Codec:
    """A byte-level tokenizer (lossless) with reserved ids after its vocabulary."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        size = self.tokenizer.get_vocab_size()
        place = {c: b for b, c in enumerate(byte_symbols())}
        self.bytes = [bytes(place[c] for c in t) if t and all(c in place for c in t) else (t or "").encode() for t in map(self.tokenizer.id_to_token, range(size))]
        self.id = {c: size + i for i, c in enumerate(CONTROLS)}
        self.size = size
        self.bytes += [c.encode() for c in CONTROLS]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.int32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode()


@lru_cache(maxsize=2)
def load(path: str) -> Codec:
    return Codec(path)


def splice(codec: Codec, roles: list[str], contents: list[np.ndarray], names: list[np.ndarray], first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of some turns in order; first: the conversation begins here."""
    parts, steps, at = ([np.array([codec.id["<s>"]], dtype=np.int32)] if first else []), [], int(first)
    for role, content, name in zip(roles, contents, names, strict=True):
        opening, closing = MARKS.get(role, _OTHER)
        head = [codec.id[opening]] if role in MARKS else [codec.id[opening], *name.tolist(), codec.id["[NAME]"]]
        parts += [np.array(head, dtype=np.int32), content, np.array([codec.id[closing], codec.id["</s>"]], dtype=np.int32)]
        begin = at + len(head)
        steps.append((begin, begin + len(content), role == "assistant"))
        at = begin + len(content) + 2
    delta = np.zeros(at + 1, dtype=np.int64)
    for begin, end, learn in steps:
        delta[begin] += learn
        delta[end] -= learn
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32), np.cumsum(delta)[:at] > 0


def read_back(codec: Codec, ids: np.ndarray) -> list[tuple[str, str, int, int]]:
    """(role, text, begin, end) of each turn: what the ids alone say. begin and end are the positions of the text's ids."""
    opens = {codec.id[o]: role for role, (o, _) in MARKS.items()} | {codec.id[_OTHER[0]]: None}
    closes = {codec.id[c] for _, c in [*MARKS.values(), _OTHER]}
    out, role, begin = [], "", 0
    for at in np.flatnonzero(ids >= codec.size).tolist():
        x = int(ids[at])
        if x in opens:
            role, begin = opens[x], at + 1
        elif x == codec.id["[NAME]"]:
            role, begin = unescape(codec.decode(ids[begin:at])), at + 1
        elif x in closes:
            out.append((role, unescape(codec.decode(ids[begin:at])), begin, at))
    return out


def format_chat(turns: DataFrame, path: str) -> DataFrame:
    """For turns (conv_id, turn, role, text): conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    path: a byte-level tokenizers JSON file that every executor has. Rows of a conversation are ordered by turn, then role, then text;
    a null turn comes first, null role and text count as empty; repeated rows are turns of their own. All figures are read back from the
    assembled ids and mask. Encoding, assembly and reading back are done turn by turn, wherever the rows are; of a text of any length, so
    is the decoding. A digest of a conversation must see its turns in order, so these stream through one task, which only hashes what was
    read back, a batch at a time, however long the conversation is. Rows of a null conv_id form one conversation. Other columns are
    dropped. An empty table gives no rows.
    """
    bound_batches(turns.sparkSession)
    lean = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])

    def assemble(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = load(path)
        for frame in frames:
            contents = codec.encode([escape(t) for t in frame["text"]])
            names = codec.encode([escape(r) if r not in MARKS else "" for r in frame["role"]])
            out = []
            for role, content, name in zip(frame["role"], contents, names, strict=True):
                ids, mask = splice(codec, [role], [content], [name], first=False)
                ((told, text, begin, end),) = read_back(codec, ids)
                learned = unescape(codec.decode(ids[begin:end][mask[begin:end]])) if mask.any() or not len(content) and told == "assistant" else None
                out.append((told, text, learned is not None, None if learned == text else learned, len(codec.decode(ids))))
            made = pd.DataFrame(out, columns=["role", "text", "learns", "learned", "rendered"])
            yield made.assign(conv_id=frame["conv_id"].array, turn=frame["turn"].array)

    # learned: where it isn't the whole text
    made = lean.mapInPandas(assemble, "conv_id long, turn long, role string, text string, learns boolean, learned string, rendered long")
    ordered = made.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, none, codec = None, object(), load(path)
        opening, _ = splice(codec, [], [], [], first=True)  # what a conversation begins with

        def done(s: dict) -> dict:
            return {"conv_id": None if s["conv"] is none else s["conv"], "n_turns": s["turns"], "turns_sha256": s["all"].hexdigest(), "loss_chars": s["chars"], "loss_sha256": s["loss"].hexdigest(), "formatted_chars": s["rendered"]}

        for frame in frames:
            out = []
            keys = [none if x is None or x != x else int(x) for x in frame["conv_id"]]
            for key, role, text, learns, learned, rendered in zip(keys, frame["role"], frame["text"], frame["learns"], frame["learned"], frame["rendered"], strict=True):
                if state is None or state["conv"] is not key and state["conv"] != key:
                    if state is not None:
                        out.append(done(state))
                    state = {"conv": key, "turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "rendered": len(codec.decode(opening))}
                state["turns"] += 1
                state["rendered"] += rendered
                state["all"].update(f"{role}\n{text}\n".encode())
                if learns:
                    learned = learned if isinstance(learned, str) else text
                    state["chars"] += len(learned)
                    state["loss"].update(learned.encode())
            if out:
                yield pd.DataFrame(out).astype({"conv_id": "Int64"})
        if state is not None:
            yield pd.DataFrame([done(state)]).astype({"conv_id": "Int64"})

    return ordered.mapInPandas(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
