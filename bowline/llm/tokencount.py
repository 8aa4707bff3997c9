"""Token counts from a byte-level BPE tokenizer compiled to finite-state transducers.

Two deterministic transducers replace the tokenizer:

* ``SplitMachine`` reads character classes and marks where pieces begin (the
  byte-level split pattern). Texts are cut into chunks; each chunk's map from
  every possible start state to its end state is built for all chunks at once,
  the maps are composed by a parallel prefix scan, and with the start states
  known every chunk is run once for its marks. A text's end is a class of its
  own, so texts of a batch are one sequence.
* ``MergeMachine`` reads the bytes of a piece; each transition is annotated
  with the change of the emitted-token count. It rests on the fact that the
  BPE encoding of any prefix is unique and is valid exactly if each pair of
  neighbouring tokens is: a state is the set of tokens in progress with the
  token before each and its count, relative to the present one. Whether two
  tokens can be neighbours follows from the ranks of the merges that made them
  and those at their seam (``MergeMachine.seam``). States and transitions are
  determinised as texts need them; at ``MAX_STATES`` the table starts anew,
  which changes no count. Counts of short pieces are remembered up to
  ``MAX_PIECES``, then the older half is forgotten. A Python worker keeps its
  tables from task to task.

The vocabulary file's path is a parameter; the driver reads it once and its
merges and character classes are broadcast (their size is the vocabulary's).
Special strings inside a text are one token each, as by the library's default.

Nulls and edges: a null text is empty; an empty text has no tokens. Very long
texts are counted whole, alone in their run of rows. Repeated rows and ids are
rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bowline.llm.bytetext import slices

CHUNK = 256
MAX_STATES = 200_000
MAX_PIECES = 500_000
PIECE_BYTES = 32
LIMIT = 1024

# character classes; letters that can follow an apostrophe have their own
LETTER, NUMBER, SPACE, BLANK, QUOTE, OTHER, ONE, RE, VE, LL, E, END = range(12)
CLASSES = 12
LETTERS = (LETTER, ONE, RE, VE, LL, E)
ALPHABET_END = 0x110000

# states, by what was read since the piece began
START, WORD, DIGITS, MARKS, SPACE1, BLANK1, SPACES, BLANKS, AFTER, AFTER_R, AFTER_V, AFTER_L, DONE = range(13)
STATES = 13
HERE, BEFORE = 1, 2  # a piece begins at this character / began at the one before


def _split_table() -> tuple[np.ndarray, np.ndarray]:
    """(next state, marks) for every state and class, from the split pattern's rules."""
    step = np.zeros((STATES, CLASSES), np.uint8)
    mark = np.zeros((STATES, CLASSES), np.uint8)
    fresh = {**{c: WORD for c in LETTERS}, NUMBER: DIGITS, OTHER: MARKS, QUOTE: AFTER, SPACE: SPACE1,
             BLANK: BLANK1, END: START}
    joined = {**{c: WORD for c in LETTERS}, NUMBER: DIGITS, OTHER: MARKS, QUOTE: MARKS}
    for s in range(STATES):
        for c in range(CLASSES):
            to, m = fresh[c], 0 if c == END else HERE  # a new piece unless a rule below joins it
            if s in (SPACE1, BLANK1, SPACES, BLANKS) and c in (SPACE, BLANK):
                to, m = SPACES if c == SPACE else BLANKS, 0
            elif s in (SPACE1, SPACES) and c != END:
                # one space belongs to what follows it; those in front of it are a piece
                to, m = joined[c], BEFORE if s == SPACES else 0
            elif s == BLANKS and c != END:
                m = HERE | BEFORE
            elif s == WORD and c in LETTERS or s == DIGITS and c == NUMBER:
                m = 0
            elif s == MARKS and c in (OTHER, QUOTE) or s == AFTER and c in (OTHER, QUOTE):
                to, m = MARKS, 0
            elif s == AFTER and c in (ONE, RE, VE, LL):
                to, m = {ONE: DONE, RE: AFTER_R, VE: AFTER_V, LL: AFTER_L}[c], 0
            elif s in (AFTER_R, AFTER_V) and c == E or s == AFTER_L and c == LL:
                to, m = DONE, 0
            elif s in (AFTER_R, AFTER_V, AFTER_L):
                # no contraction: the letter after the apostrophe began a word
                m = BEFORE | (0 if c in LETTERS else m)
            step[s, c], mark[s, c] = to, m
    return step, mark


class SplitMachine:
    def __init__(self):
        step, mark = _split_table()
        self.step = (step * CLASSES).ravel()  # states are held times CLASSES, so a sum is the index
        self.mark = mark.ravel()

    def marks(self, classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
        """Marks of every character; the sequence starts a text."""
        n = len(classes)
        rows = -(-n // chunk)
        grid = np.full(rows * chunk, END, np.uint8)
        grid[:n] = classes
        columns = np.ascontiguousarray(grid.reshape(rows, chunk).T)
        maps = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None] * np.uint8(CLASSES), rows, axis=1)
        for c in columns:
            maps = self.step[maps + c]
        state = self._starts(maps // np.uint8(CLASSES)) * np.uint8(CLASSES)
        out = np.empty((chunk, rows), np.uint8)
        for i, c in enumerate(columns):
            at = state + c
            out[i] = self.mark[at]
            state = self.step[at]
        return out.T.ravel()[:n]

    @staticmethod
    def _starts(maps: np.ndarray) -> np.ndarray:
        """Start state of every chunk, by a prefix scan over the composition of the chunk maps."""
        done, width = maps.copy(), 1
        while width < done.shape[1]:
            done[:, width:] = np.take_along_axis(done[:, width:], done[:, :-width], axis=0)
            width *= 2
        return np.concatenate([[START], done[START, :-1]]).astype(np.uint8)


class MergeMachine:
    """Token counts of byte strings under ranked merges of a byte-level BPE vocabulary."""

    def __init__(self, tokens: list[bytes], merges: list[tuple[int, int, int]], max_states: int = MAX_STATES):
        self.merge = {(a << 20) | b: (rank, to) for rank, (a, b, to) in enumerate(merges)}
        self.tokens, self.max_states = tokens, max_states
        self.byte_token = {t[0]: i for i, t in enumerate(tokens) if len(t) == 1}
        self.children: list[dict[int, int]] = [{}]  # of every node of the tokens' trie
        self.token_at = [-1]
        for i, t in enumerate(tokens):
            node = 0
            for b in t:
                to = self.children[node].get(b)
                if to is None:
                    to = self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                node = to
            self.token_at[node] = i if node else -1
        self.fits: dict[int, bool] = {}
        self.counts: dict[bytes, int] = {}
        self._clear()
        self._split_trees(merges)

    def _split_trees(self, merges: list[tuple[int, int, int]]) -> None:
        """The merge that makes each token from its own bytes; tokens that no bytes become are not ``whole``."""
        base = set(self.byte_token.values())
        self.made = [-1 if i in base else 1 << 30 for i in range(len(self.tokens))]
        self.left, self.right = list(range(len(self.tokens))), list(range(len(self.tokens)))
        self.whole = [i in base for i in range(len(self.tokens))]
        # learned merges come after the tokens they join; with any other order seams are settled by encoding
        self.learned = True
        for rank, (a, b, to) in enumerate(merges):
            self.learned &= self.made[a] < rank and self.made[b] < rank
            if self.whole[to] or not (self.whole[a] and self.whole[b]) or not self.learned or not self.seam(a, b, rank):
                continue
            self.made[to], self.left[to], self.right[to], self.whole[to] = rank, a, b, True
        if not self.learned:
            self.whole = [bool(t) and self.encode(t) == [i] for i, t in enumerate(self.tokens)]

    def seam(self, a: int, b: int, until: int = 1 << 30) -> bool:
        """Whether nothing merges across the seam of a and b before the merge of rank ``until``.

        Walks back in time along the right edge of a's merges and the left edge of b's. Two tokens there
        stood side by side until the earlier of them was merged on, so a merge of them of a lower rank
        would have come first; of equal ranks the left one comes first.
        """
        on_a = on_b = until
        merge, made = self.merge, self.made
        while True:
            at = merge.get((a << 20) | b)
            if at is not None and at[0] < on_a and (at[0] < on_b or at[0] == on_b != until):
                return False
            if made[a] > made[b]:
                on_a, a = made[a], self.right[a]
            elif made[b] >= 0:
                on_b, b = made[b], self.left[b]
            else:
                return True

    def _clear(self) -> None:
        first = ((-1, 0, 0),)
        self.live, self.number, self.step = [first], {first: 0}, {}

    def encode(self, raw: bytes) -> list[int]:
        """Plain BPE by ranks."""
        ids = [self.byte_token[b] for b in raw]
        while len(ids) > 1:
            best = min((self.merge.get((a << 20) | b, (1 << 30, 0)) for a, b in zip(ids, ids[1:])))
            if best[0] == 1 << 30:
                break
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and self.merge.get((ids[i] << 20) | ids[i + 1]) == best:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def _fit(self, a: int, b: int) -> bool:
        """Whether token b can follow token a."""
        if a < 0:
            return self.whole[b]
        key = (a << 20) | b
        ok = self.fits.get(key)
        if ok is None:
            if len(self.fits) > 4 * self.max_states:
                self.fits.clear()
            if self.learned:
                ok = self.whole[a] and self.whole[b] and self.seam(a, b)
            else:
                ok = self.encode(self.tokens[a] + self.tokens[b]) == [a, b]
            self.fits[key] = ok
        return ok

    def _grow(self, state: int, byte: int) -> tuple[int, int]:
        """Determinise one transition: (next state, change of the count).

        The tokens in progress of a state stand in the order of their first bytes.
        """
        ahead, last, change = [], -1, 0
        children, token_at = self.children, self.token_at
        for before, node, count in self.live[state]:
            to = children[node].get(byte)
            if to is None:
                continue
            if last < 0 and token_at[to] >= 0 and self._fit(before, token_at[to]):
                last, change = token_at[to], count + 1
            if children[to]:
                ahead.append((before, to, count))
        # relative to the count after this byte; the new token may be followed by any
        if change:
            ahead = [(b, n, c - change) for b, n, c in ahead]
        ahead.append((last, 0, 0))
        held = tuple(ahead)
        to = self.number.get(held)
        if to is None:
            to = self.number[held] = len(self.live)
            self.live.append(held)
        self.step[(state << 8) | byte] = (to, change)
        return to, change

    def count(self, piece: bytes) -> int:
        if len(self.live) > self.max_states:
            self._clear()
        state = total = 0
        step = self.step.get
        for b in piece:
            at = step((state << 8) | b)
            state, change = at if at is not None else self._grow(state, b)
            total += change
        return total

    def remembered(self, piece: bytes) -> int:
        n = self.counts.get(piece)
        if n is None:
            n = self.count(piece)
            if len(piece) <= PIECE_BYTES:
                if len(self.counts) >= MAX_PIECES:
                    for old in list(islice(self.counts, MAX_PIECES // 2)):
                        del self.counts[old]
                self.counts[piece] = n
        return n


def _byte_symbols() -> dict[str, int]:
    """The printable symbol that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in shown]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(rest)}}


@cache
def _classes() -> np.ndarray:
    """Class of every code point, by the split pattern's own regex engine.

    One pass cuts all code points into runs of one class; the classes of the runs follow from their first characters.
    """
    from tokenizers import Regex, pre_tokenizers

    every = "".join(chr(c) for c in range(ALPHABET_END) if not 0xD800 <= c < 0xE000)

    def cut(pattern: str, text: str, behavior: str) -> list[tuple[int, int]]:
        return [at for _, at in pre_tokenizers.Split(Regex(pattern), behavior).pre_tokenize_str(text)]
    runs = cut(r"\p{L}+|\p{N}+|\s+", every, "isolated")
    firsts = "".join(every[s] for s, _ in runs)
    of_run = np.full(len(runs), OTHER, np.uint8)
    for pattern, c in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", BLANK)):
        inside = np.ones(len(runs), np.bool_)
        for s, e in cut(pattern, firsts, "removed"):
            inside[s:e] = False
        of_run[inside] = c
    got = np.repeat(of_run, [e - s for s, e in runs])
    out = np.full(ALPHABET_END, OTHER, np.uint8)
    out[:0xD800], out[0xE000:] = got[:0xD800], got[0xD800:]
    for chars, c in (("stmd", ONE), ("r", RE), ("v", VE), ("l", LL), ("e", E), (" ", SPACE), ("'", QUOTE)):
        for ch in chars:
            out[ord(ch)] = c
    return out


def compile_tokenizer(path: str) -> dict:
    """What the tasks need of a byte-level BPE tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = spec["pre_tokenizer"]
    if spec["model"]["type"] != "BPE" or spec["normalizer"] or split["type"] != "ByteLevel" \
            or split["add_prefix_space"] or not split["use_regex"]:
        raise ValueError("only byte-level BPE tokenizers with the standard split can be compiled")
    model = spec["model"]
    odd = [k for k in ("ignore_merges", "byte_fallback", "unk_token", "continuing_subword_prefix", "end_of_word_suffix",
                       "dropout") if model.get(k)]
    odd += [k for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized") if t.get(k)]
    if odd:
        raise ValueError(f"tokenizer settings that are not compiled: {', '.join(sorted(set(odd)))}")
    byte_of = _byte_symbols()
    vocab = spec["model"]["vocab"]
    special = [t["content"] for t in spec["added_tokens"]]
    tokens = [b""] * (max(vocab.values()) + 1)
    for t, i in vocab.items():
        if t not in special:
            tokens[i] = bytes(byte_of[c] for c in t)
    pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    return {"tokens": tokens, "merges": [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs],
            "special": [s.encode() for s in special], "classes": _classes()}


def _cut(raw: bytes, special: list[bytes]) -> list[bytes]:
    parts = [raw]
    for s in special:
        parts = [x for p in parts for x in p.split(s)]
    return parts


class Counter:
    """Token counts of the rows of a string column."""

    def __init__(self, spec: dict):
        self.special, self.classes = spec["special"], spec["classes"]
        self.split = SplitMachine()
        self.merge = MergeMachine(spec["tokens"], spec["merges"])

    def slice_counts(self, raw: bytes, offs: np.ndarray) -> np.ndarray:
        extra = np.zeros(len(offs) - 1, np.int64)
        if any(s in raw for s in self.special):
            parts, owner = [], []
            for r in range(len(offs) - 1):
                cut = _cut(raw[offs[r]:offs[r + 1]], self.special)
                parts += cut
                owner += [r] * len(cut)
                extra[r] = len(cut) - 1
            raw, offs = b"".join(parts), np.cumsum([0] + [len(p) for p in parts])
            return extra + np.bincount(owner, self._plain(raw, offs), len(extra)).astype(np.int64)
        return self._plain(raw, offs)

    def _plain(self, raw: bytes, offs: np.ndarray) -> np.ndarray:
        data = np.frombuffer(raw, np.uint8)
        chars = np.flatnonzero((data & 0xC0) != 0x80)
        first = np.searchsorted(chars, offs)  # first character of each row
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        ends = first[1:]
        marks = self.split.marks(np.insert(self.classes[points], ends, END))
        # END marks sit after every row: drop them, after handing a BEFORE mark to the row's last character
        at_end = ends + np.arange(len(ends))
        late = (marks & BEFORE) != 0
        begins = (marks & HERE) != 0
        begins[:-1] |= late[1:]
        keep = np.ones(len(marks), np.bool_)
        keep[at_end] = False
        starts = np.flatnonzero(begins[keep])
        cut = np.append(chars[starts], len(raw)).tolist()
        count = self.merge.remembered
        known = self.merge.counts.get
        got = [known(p) or count(p) for p in map(raw.__getitem__, map(slice, cut, cut[1:]))]
        total = np.concatenate([[0], np.cumsum(got)]).astype(np.int64)
        return np.diff(total[np.searchsorted(starts, first)])


_HELD: list = []  # the tokenizer and the counter that this Python worker used last


def _counter(spec: dict) -> Counter:
    if not _HELD or _HELD[0] is not spec:
        _HELD[:] = [spec, Counter(spec)]
    return _HELD[1]


def _count(spec) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(spec.value)
        for batch in batches:
            for lo, hi, raw, offs in slices(batch.column(1)):
                n = counter.slice_counts(raw.tobytes(), offs)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(offs)), pa.array(n)],
                    names=["doc_id", "n_bytes", "n_tokens"])
    return run


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    spec = docs.sparkSession.sparkContext.broadcast(compile_tokenizer(path))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(_count(spec), f"doc_id {kind}, n_bytes long, n_tokens long")
