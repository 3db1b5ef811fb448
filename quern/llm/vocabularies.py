"""Encoding with the libraries' own tokenizers, chunk by chunk.

A text is cut at boundaries over which the vocabulary has no merge, so the tokens of the text are the tokens of its chunks.
Chunks repeat, so each task's process encodes a chunk once and remembers a bounded number of them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import cache

import numpy as np

from quern.llm.batches import held

#: Chunks and their characters that a process remembers in each of two generations.
MEMO_CHUNKS, MEMO_CHARS = 500_000, 8_000_000
#: The same for pieces, which are encoded faster.
PIECE_CHUNKS, PIECE_CHARS = 150_000, 4_000_000
ENCODE_BYTES = 1 << 18


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkMemo:
    """Values of chunks: recent ones in `new`, those of the generation before in `old`."""

    def __init__(self, encode: Callable[[list[str]], Iterable], chunks: int = MEMO_CHUNKS, chars: int = MEMO_CHARS):
        self.encode, self.most, self.most_chars = encode, chunks, chars
        self.new: dict = {}
        self.old: dict = {}
        self.chars = 0

    def of(self, wanted: set[str]) -> dict:
        """A mapping that has every wanted chunk. It holds until the next call."""
        if len(self.new) > self.most or self.chars > self.most_chars:
            self.old, self.new, self.chars = self.new, {}, 0
        new, old, unseen = self.new, self.old, []
        for chunk in wanted:
            if chunk not in new:
                if (value := old.get(chunk)) is None:
                    unseen.append(chunk)
                else:
                    new[chunk] = value
                    self.chars += len(chunk)
        start = size = 0
        for k, chunk in enumerate(unseen):  # batches balanced by bytes
            size += len(chunk) + 4
            if size > ENCODE_BYTES or k + 1 == len(unseen):
                part = unseen[start : k + 1]
                new.update(zip(part, self.encode(part)))
                self.chars += sum(map(len, part))
                start, size = k + 1, 0
        return new


# ---- sentencepiece, identity normaliser, dummy prefix, no piece with a space or line feed after its start

_PIECE_CHUNK = re.compile(r"\n[^ \n]*| +[^ \n]*")


def piece_chunks(text: str) -> list[str]:
    """Cut before each line feed and each run of spaces. The first character is the space that the library puts in front."""
    return _PIECE_CHUNK.findall(" " + text.replace("▁", " ")) if text else []


@cache
def piece_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def safe_piece_model(path: str) -> bool:
    """Whether no piece joins what piece_chunks() cuts apart."""
    model = piece_model(path)
    return not any(re.search("\n|[^▁]▁", model.id_to_piece(i)) for i in range(model.get_piece_size()))


def _piece_encoder(path: str, value: Callable):
    if not safe_piece_model(path):
        raise ValueError(f"{path} has pieces over white space; chunks would not give its tokens")
    model = piece_model(path)
    space = [model.piece_to_id("▁")]

    def encode(chunks: list[str]) -> Iterable:
        got = model.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        return [value(space if c == " " else ids if c[0] == " " else ids[1:]) for c, ids in zip(chunks, got)]

    return encode


def piece_counts(path: str) -> ChunkMemo:
    return held(("piece_counts", path), lambda: ChunkMemo(_piece_encoder(path, len), PIECE_CHUNKS, PIECE_CHARS))


def piece_ids(path: str) -> ChunkMemo:
    return held(("piece_ids", path), lambda: ChunkMemo(_piece_encoder(path, lambda ids: np.array(ids, "<u4").tobytes()), PIECE_CHUNKS, PIECE_CHARS))


@cache
def byte_pieces(path: str) -> np.ndarray:
    """Whether an id is a byte that stands in for a character outside the vocabulary."""
    model = piece_model(path)
    return np.array([model.is_byte(i) for i in range(model.get_piece_size())])


# ---- tokenizers, word BPE: white space dropped, no merge over it


#: What every special string of the vocabulary has. The library looks for special strings before it lowers capitals.
_SPECIAL = "<|"


def word_chunks(text: str) -> list[str]:
    """Cut at spaces and line feeds. The vocabulary has no capitals, so A-Z are lowered and more chunks are equal; chunks that may hold a special string stay as they are."""
    lowered = text.encode().lower().replace(b"\n", b" ").decode().split(" ")
    return [a if _SPECIAL in a else b for a, b in zip(text.replace("\n", " ").split(" "), lowered)] if _SPECIAL in text else lowered


def safe_word_vocabulary(path: str) -> bool:
    """Whether capitals are lowered, and special strings have no white space and all begin with _SPECIAL."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = spec["normalizer"].get("normalizers", [spec["normalizer"]])
    special = [t["content"] for t in spec["added_tokens"]]
    return "Lowercase" in [n["type"] for n in steps] and all(t.startswith(_SPECIAL) and not re.search("\\s", t) for t in special)


#: A token of its own between spaces, which no text without the character has.
_MARK = "|"


def word_bpe_ids(path: str, chunks: int = MEMO_CHUNKS) -> ChunkMemo:
    """Ids of a chunk as little-endian unsigned 32-bit bytes. Chunks are encoded together, with a mark between them at which the ids are cut again. chunks: how many a generation remembers, of some 200 bytes."""
    return held(("word_bpe_ids", path, chunks), lambda: _word_bpe_memo(path, chunks))


def _word_bpe_memo(path: str, chunks: int) -> ChunkMemo:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    if not safe_word_vocabulary(path):
        raise ValueError(f"{path} has tokens that chunks would not give")
    tokenizer = Tokenizer.from_file(path)
    ids_of = lambda texts: [np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    mark = ids_of([_MARK])[0]

    def encode(chunks: list[str]) -> list[bytes]:
        plain = [c for c in chunks if _MARK not in c]
        if len(mark) == 1 and plain:
            ids = ids_of([f" {_MARK} ".join(plain)])[0]
            at = np.flatnonzero(ids == mark[0]) * 4
            if len(at) == len(plain) - 1:
                raw, at = ids.tobytes(), at.tolist()
                parts = dict(zip(plain, (raw[a:b] for a, b in zip([0, *(x + 4 for x in at)], [*at, len(raw)]))))
                rest = [c for c in chunks if c not in parts]
                parts |= zip(rest, (x.tobytes() for x in ids_of(rest)))
                return [parts[c] for c in chunks]
        return [x.tobytes() for x in ids_of(chunks)]

    return ChunkMemo(encode, chunks)
