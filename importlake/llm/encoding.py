"""Encoding with the public tokenizers, one chunk of text at a time.

A chunk is what lies between single spaces that have other characters on both sides; its tokens begin with the space. Neither tokenizer has a token across such a place, so the ids
of a text are those of its chunks in a row, and a chunk that comes again is looked up instead of encoded. Where the library's
settings would break this, an error says so.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterable
from itertools import accumulate, chain

import numpy as np

#: A single space. Python's white space covers Unicode's, so a place that is odd to either side is left whole.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: In front of a chunk that has no space before it, as the first of a text. No chunk has a single space inside.
FIRST = "^ ^"
#: Letters, perhaps behind a space, and perhaps one mark at the end: two runs of the byte-level pattern at most, so they can go to the model as they are.
RUNS = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]?)")
#: Around a single line feed, which is a token of its own: the byte-level pattern puts no other white space to it.
LINE = re.compile(r"(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")
MARKS = list(".,;:!?")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others by rank from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + k) for k, b in enumerate(others)}


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.fromiter(map(len, lists), np.int64, len(lists)).cumsum()
    return np.fromiter(chain.from_iterable(lists), np.int64, int(ends[-1]) if len(ends) else 0), ends


def spelled(chunk: str) -> str:
    """A chunk as it stands in the text."""
    return chunk[len(FIRST) :] if chunk.startswith(FIRST) else " " + chunk


def chunk_of(text: str) -> str:
    return text[1:] if text[0] == " " else FIRST + text


class Chunks(dict):
    """The packed ids of chunks, filled as they are asked for. When they are too many, those not asked for since the last time go."""

    kind = np.dtype("<u2")

    def __init__(self, most: int = 900_000):
        super().__init__()
        self.most, self.older = most, {}

    def learn(self, chunks: set[str]) -> None:
        """Encode chunks that aren't known."""
        raise NotImplementedError

    def put(self, chunks: list[str], flat: np.ndarray, ends: np.ndarray) -> None:
        """Keep the ids ``flat``, those of each chunk up to its end: packed, as many small lists would cost more than they are worth."""
        packed, cuts = flat.astype(self.kind).tobytes(), (ends * self.kind.itemsize).tolist()
        self.update(zip(chunks, map(packed.__getitem__, map(slice, [0, *cuts], cuts))))

    def forget(self) -> None:
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()

    def of(self, chunks: list[str]) -> list[bytes]:
        """The packed ids of each chunk."""
        found = list(map(self.get, chunks))
        if None in found:
            unseen = [k for k, x in enumerate(found) if x is None]
            asked = {chunks[k] for k in unseen}
            if self.older:
                again = asked & self.older.keys()
                self.update(zip(again, map(self.older.__getitem__, again)))
                asked -= again
            if asked:
                self.learn(asked)
            for k in unseen:
                found[k] = self[chunks[k]]
        return found

    def texts(self, texts: list[str | None]) -> list[bytes]:
        """The packed ids of each text; null has none."""
        self.forget()
        cut = [CUT.split(t) if t else [] for t in texts]
        for x in cut:
            if x:
                x[0] = FIRST + x[0] if x[0][0] != " " else x[0][1:]
        ids = self.of(list(chain.from_iterable(cut)))
        ends = list(accumulate(map(len, cut), initial=0))
        return [b"".join(ids[i:j]) for i, j in zip(ends, ends[1:])]


class ByteLevel(Chunks):
    """Chunks of a byte-level file of the tokenizers library. ``plain_specials`` takes special tokens in a text as ordinary text."""

    def __init__(self, path: str, plain_specials: bool = False, most: int = 900_000):
        super().__init__(most)
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task has one core
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = plain_specials
        said = json.loads(self.whole.to_str())
        before, model = said["pre_tokenizer"] or {}, said["model"]
        odd = [k for k in ("truncation", "padding", "normalizer", "post_processor") if said[k]] + [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
        if odd or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError(f"{path} can't be used chunk by chunk: {', '.join(odd) or 'its pre-tokenizer'}")
        for token in said["added_tokens"]:
            if token["single_word"] or token["lstrip"] or token["rstrip"] or " " in token["content"] or RUNS.fullmatch(token["content"]):
                raise ValueError(f"{path} can't be used chunk by chunk: {token['content']}")
        self.size = self.whole.get_vocab_size()
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        # For chunks without a special token, both ways of taking it are the same; then it serves to set chunks apart.
        special = next((t for t in said["added_tokens"] if t["special"] and not t["normalized"]), None)
        if special is None or RUNS.search(special["content"][0]):
            raise ValueError(f"{path} has no special token to set chunks apart")
        self.between, self.between_id = special["content"], special["id"]
        self.split, self.runs = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.runs.pre_tokenizer = None
        letters = byte_letters()
        self.letter = str.maketrans({chr(b): x for b, x in letters.items()})
        own = {x: b for b, x in letters.items()}
        specials = {t["id"]: t["content"].encode() for t in said["added_tokens"]}
        self.bytes = [specials[i] if i in specials else bytes(own[c] for c in self.whole.id_to_token(i) or "") for i in range(self.size)]

    def learn(self, chunks: set[str]) -> None:
        """Runs of letters go straight to the model, all else through the library's own pattern."""
        asked = {spelled(c): c for c in chunks}
        lines = {c: LINE.split(c) for c in asked if "\n" in c}
        whole = {c: x for c, x in lines.items() if len(x) > 1}
        runs, rest, marked = set(), [], []
        for c in chain((asked.keys() - whole.keys()), {x for parts in whole.values() for x in parts if chunk_of(x) not in self}) if whole else asked:
            if m := RUNS.fullmatch(c):
                run, mark = m.groups()
                if chunk_of(run) not in self:
                    runs.add(run)
                if mark:
                    marked.append((chunk_of(c), chunk_of(run), FIRST + mark))
            else:
                rest.append(c)
        letters = list(runs)
        mapped = ["Ġ" + c[1:] if c[0] == " " and c.isascii() else c if c.isascii() else c.encode().decode("latin-1").translate(self.letter) for c in letters]
        for of, given, tokenizer in ((letters, mapped, self.runs), (rest, rest, self.split), (MARKS, MARKS, self.split)):
            odd = [c for c in given if self.between in c]
            if odd:
                self.put(list(map(chunk_of, odd)), *_flat([e.ids for e in self.whole.encode_batch_fast(odd, add_special_tokens=False)]))
                of = given = [c for c in given if self.between not in c]
            self.put(list(map(chunk_of, of)), *self.together(tokenizer, given))
        self.update([(c, self[run] + self[mark]) for c, run, mark in marked])
        self.update([(chunk_of(c), b"".join([self[chunk_of(x)] for x in parts])) for c, parts in whole.items()])

    def together(self, tokenizer, chunks: list[str], many: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks, and where each chunk ends. Many are encoded as one text with a special token behind each, at which the library cuts first."""
        texts = [self.between.join(chunks[k : k + many]) + self.between for k in range(0, len(chunks), many)]
        ids = [np.array(e.ids, np.int64) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        flat = np.concatenate([np.zeros(0, np.int64), *ids])
        last = np.flatnonzero(flat == self.between_id)
        return flat[flat != self.between_id], last - np.arange(len(last))


class SentencePieces(Chunks):
    """Chunks of a SentencePiece model that adds the space in front. No piece may hold a space behind another letter."""

    def __init__(self, path: str, most: int = 900_000):
        super().__init__(most)
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        names = [self.model.id_to_piece(i) for i in range(self.size)]
        if any("▁" in x.lstrip("▁") for x in names):
            raise ValueError(f"{path} can't be used chunk by chunk: a piece has a space inside")
        byte = lambda i: bytes([int(names[i][3:5], 16)])
        self.bytes = [
            byte(i) if self.model.is_byte(i) else b"" if self.model.is_control(i) or self.model.is_unused(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)
        ]

    def learn(self, chunks: set[str]) -> None:
        new = list(chunks)
        self.put(new, *_flat(self.model.encode(new, num_threads=1)))


@functools.cache
def byte_level(path: str, plain_specials: bool = False) -> ByteLevel:
    """One for each worker, so that what it has learned serves the next task too."""
    return ByteLevel(path, plain_specials)


@functools.cache
def sentence_pieces(path: str) -> SentencePieces:
    return SentencePieces(path)
