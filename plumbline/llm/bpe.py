"""Byte-pair encoding by an automaton built from the merges.

Two machines.  The first reads tokens.  It starts with one state that loops on every base symbol.  The
gadget of a merge (u, v) -> w cuts, in rank order, the path u then v: the state reached by u is copied
without its v arc, the u arcs lead to the copy, and every state with a u arc gets a w arc to where v
led.  After all merges its paths are exactly the encodings, so each word has one path, and so has each
beginning of a word.  Two facts keep it small: the state that a token leads to depends on the token
alone, so a state is named by its token (and the rank up to which its cuts count); and an arc of a
state either was there when the state was copied or came with a merge of that arc's left part.
``Automaton`` therefore stores, per token, the rank it came with and its two parts, and, per cut arc,
the rank of the cut.

The second reads symbols and is deterministic.  Its state is what the first machine's single path to
here leaves open: the longest read suffix that begins a label, and the last label of the path to each
place in it.  A symbol leads on to the one label that ends at it and continues the path of what is
before; ``step`` finds it and enters it in the transition table, so each state and symbol is worked out
once and then is a look-up.  A word takes one transition per symbol, without going back; from its end
the labels chain to its beginning.  Emitting them decodes.
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import give_back, text_bytes

#: Entries of a generation of the word tables of a worker.  A full word table becomes the old generation,
#: which the next one draws on, so frequent words stay.
WORDS = 300_000
#: Entries of the transition table; a full one starts anew.
ARCS = 300_000
#: Documents per Arrow batch that goes back.
ROWS = 256


class Automaton:
    def __init__(self, vocab: dict[str, int], merges: list, end: str = "</w>"):
        self.end = end
        self.labels = {i: t for t, i in vocab.items()}
        made = {u + v for u, v in merges}
        self.born: dict[int, int] = {i: 0 for t, i in vocab.items() if t not in made}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.cut: dict[tuple[int, int], int] = {}
        for rank, (u, v) in enumerate(merges, 1):
            a, b, w = vocab[u], vocab[v], vocab[u + v]
            # a gadget needs the path u then v, and gives an arc whose label is new
            if a in self.born and b in self.born and w not in self.born and self._follow(a, b, rank - 1):
                self.cut[a, b] = rank
                self.born[w], self.left[w], self.right[w] = rank, a, b
        self.rank = len(merges)
        self.ids = {t: i for t, i in vocab.items() if i in self.born}
        #: labels by what they read, those that end a word apart, with their lengths; beginnings of labels
        self.finals = {t.removesuffix(end): i for t, i in self.ids.items() if t.endswith(end)}
        self.inner = {t: i for t, i in self.ids.items() if not t.endswith(end)}
        self.size = {i: len(t) for part in (self.finals, self.inner) for t, i in part.items()}
        self.begins = {t[:k] for part in (self.finals, self.inner) for t in part for k in range(1, len(t))}
        self._empty()

    def _empty(self) -> None:
        """The transition table with nothing but the start."""
        start = ("", (-1,))
        self.states, self.index, self.last = [start], {start: 0}, [-1]
        self.next: dict[int, int] = {}
        self.ends: dict[int, int] = {}

    def arc(self, state: int, label: int) -> bool:
        """Whether the state that ``state`` leads to has an arc ``label``; the start (-1) has all."""
        return state < 0 or self._follow(state, label, self.rank)

    def step(self, state: int, symbol: str) -> int:
        """The transition of a symbol that doesn't end the word, entered in the table."""
        suffix, lasts = self.states[state]
        read = suffix + symbol
        label = self._only(self.inner, read, lasts)
        lasts = (*lasts, label)
        k = 0
        while k < len(read) and read[k:] not in self.begins:
            k += 1
        to = (read[k:], lasts[k:])
        number = self.index.get(to)
        if number is None:
            number = self.index[to] = len(self.states)
            self.states.append(to)
            self.last.append(label)
        self.next[state << 21 | ord(symbol)] = number
        return number

    def finish(self, state: int, symbol: str) -> int:
        """The label that the last symbol of a word completes, entered in the table."""
        suffix, lasts = self.states[state]
        label = self.ends[state << 21 | ord(symbol)] = self._only(self.finals, suffix + symbol, lasts)
        return label

    def _only(self, labels: dict[str, int], read: str, lasts: tuple[int, ...]) -> int:
        """The one label that ends ``read`` and continues the path before it."""
        for k, before in enumerate(lasts):
            label = labels.get(read[k:])
            if label is not None and self.arc(before, label):
                return label
        raise ValueError(f"no path for {read!r}")

    def _follow(self, state: int, label: int, upto: int) -> bool:
        born, cut = self.born, self.cut
        while True:
            gone = cut.get((state, label))
            if gone is not None and gone <= upto:
                return False
            s, x = born[state], born[label]
            if s == x == 0:
                return True
            if x > s:  # the arc came by its merge to every state that then had the left part's arc
                upto, label = x, self.left[label]
            else:  # the state is what the right part led to just before its merge
                upto = s - 1
                if label == state:
                    label = self.left[state]
                state = self.right[state]

    def read(self, word: str) -> list[int]:
        """The path of a word, given as base symbols; its last symbol takes the end mark."""
        whole = self.ids.get(word + self.end)
        if whole is not None:
            return [whole]
        if len(self.next) + len(self.ends) > ARCS:
            self._empty()
        table, last, state, labels = self.next, self.last, 0, []
        for symbol in word[:-1]:
            to = table.get(state << 21 | ord(symbol))
            state = self.step(state, symbol) if to is None else to
            labels.append(last[state])
        label = self.ends.get(state << 21 | ord(word[-1]))
        if label is None:
            label = self.finish(state, word[-1])
        path, at = [label], len(word) - self.size[label]
        while at:
            label = labels[at - 1]
            path.append(label)
            at -= self.size[label]
        path.reverse()
        return path

    def emit(self, path: list[int]) -> str:
        return " ".join(map(self.labels.__getitem__, path))


def byte_symbols() -> list[str]:
    """A printable character for each byte: itself where it is one, else the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, more = [], 0
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(0x100 + more))
            more += 1
    return out


#: The split pattern of the vocabulary file for ASCII pieces without white space, lower case.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+")


class Encoder:
    """Pre-splits as the vocabulary file says, then reads each word with the automaton.

    A piece between ASCII white space is looked up as a whole; only unseen pieces are split.  Special
    tokens are found in the raw piece, before anything is normalised.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.automaton = Automaton(model["vocab"], merges, model["end_of_word_suffix"])
        self.automaton.labels |= {i: t for t, i in self.special.items()}
        self._specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self._symbols = byte_symbols()
        self._path = path
        self._library = None
        self.words: dict[bytes, list[int]] = {}
        self.old_words: dict[bytes, list[int]] = {}
        self.paths: dict[str, list[int]] = {}
        self.old_paths: dict[str, list[int]] = {}

    def _split(self, piece: str) -> Iterator[str]:
        """Words of a piece as byte symbols."""
        low = piece.lower()
        if low.isascii():
            if low.isalpha():
                yield low
                return
            for word in _ASCII.findall(low):
                yield word if word.isprintable() else "".join([self._symbols[b] for b in word.encode()])
            return
        # precomposed Latin letters are their own normal form, and lower-case one by one
        stem, tail = (low[:-1], low[-1]) if low[-1] in ".,;:!?" else (low, "")
        if stem.isalpha() and max(stem) < "\u0250":
            yield "".join([self._symbols[b] for b in stem.encode()])
            if tail:
                yield tail
            return
        if self._library is None:  # Unicode normal forms and classes are the library's
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
        for word, _ in self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(piece)):
            yield word

    def piece(self, raw: bytes) -> list[int]:
        text = raw.decode("utf-8", "replace")
        if self._specials is None or "<|" not in text:
            return self._words(text)
        path: list[int] = []
        for part in self._specials.split(text):
            if part in self.special:
                path.append(self.special[part])
            elif part:
                path += self._words(part)
        return path

    def _words(self, text: str) -> list[int]:
        path: list[int] = []
        for word in self._split(text):
            known = self.paths.get(word)
            if known is None:
                known = self.old_paths.get(word)
                if known is None:
                    known = self.automaton.read(word)
                if len(word) <= 64:
                    if len(self.paths) >= WORDS // 2:
                        self.old_paths, self.paths = self.paths, {}
                    self.paths[word] = known
            path = path + known if path else known
        return path

    def encode(self, text: bytes) -> tuple[list[int], str]:
        """Ids of a whole text, and the labels they emit, joined as the file's (absent) decoder does."""
        words, ids = self.words, []
        for raw in text.split():
            held = words.get(raw)
            if held is None:
                held = self.old_words.get(raw)
                if held is None:
                    held = self.piece(raw)
                if len(raw) <= 64:
                    if len(words) >= WORDS:
                        self.old_words, words = words, {}
                        self.words = words
                    words[raw] = held
            ids += held
        return ids, self.automaton.emit(ids)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _encode(path_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path_of())
        gc.disable()  # the tables hold no cycles; walking them again and again would cost more than reading
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                done = [own.encode(x.as_py()) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x[0] for x in done], pa.list_(pa.int32())), pa.array([x[1] for x in done], pa.string())], ["doc_id", "token_ids", "decoded"])
        # the worker may serve other stages next: tables and automaton go
        del own
        encoder.cache_clear()
        gc.enable()
        give_back()

    return run


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, token_ids, decoded for each row of ``docs`` (doc_id, text): a scan without shuffle.

    ``path`` is the vocabulary file on the executors (default: where the installed package has it).  A
    null text is empty; an empty text has no tokens and decodes to the empty string.  Repeated rows
    give repeated results; other columns are ignored.
    """
    path_of = (lambda: tokenizer_path()) if path is None else (lambda: path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return rows.mapInArrow(_encode(path_of), "doc_id long, token_ids array<int>, decoded string")


def _decode(path_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path_of())
        for batch in batches:
            texts = [own.automaton.emit(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return run


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, decoded for each row of ``encoded`` (doc_id, token_ids); null ids decode to ""."""
    path_of = (lambda: tokenizer_path()) if path is None else (lambda: path)
    return encoded.select("doc_id", "token_ids").mapInArrow(_decode(path_of), "doc_id long, decoded string")


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    """doc_id, n_tokens, the hashes of ids and decoded text, and more columns of ``encode``."""
    joined = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return encoded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        *more,
    )
