import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from bowline.llm import tokencount  # noqa: E402
from bowline.llm.queries import QUERIES  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", "a", " ", "  ", "\n", "it's we're they'll I'd 'tis 'r x've 'l '", "  's", "\n's", "a  b", "a \n b", "\n\n x", "x\n",
         "é日本 العربية ١٢ x", "'s's'st", "!'s", "<|endoftext|>a<|endoftext|> b", "<|endoftext|>", " <|endoftext|> ", "'r", "'ve", "'rx",
         "don't  ", "\t\tfoo  bar baz　x", "a" * 500, "1234567890 " * 5, "'re'll'v", "'r're", "Wörter über 🙂🙂 ​ x",
         "DON'T 'S 'LL", "word " * 20_000]


@pytest.fixture(scope="module")
def counter():
    return tokencount.Counter(tokencount.compile_tokenizer(PATH))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def mine(counter, texts):
    raw = [t.encode() for t in texts]
    return counter.slice_counts(b"".join(raw), np.cumsum([0] + [len(r) for r in raw])).tolist()


def theirs(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_counts_equal_the_library(counter, library):
    r = random.Random(1)
    texts = TEXTS + ["".join(r.choice("ab'strvlemd  \n\t!?12é日 ́ABTHE") for _ in range(r.randint(0, 40))) for _ in range(3000)]
    assert mine(counter, texts) == theirs(library, texts)


def test_a_small_state_table_changes_nothing(library):
    spec = tokencount.compile_tokenizer(PATH)
    machine = tokencount.MergeMachine(spec["tokens"], spec["merges"], max_states=50)
    words = ["internationalization", " unbelievable", "antidisestablishmentarianism", "ñandúes", "xyzzyqwert"] * 3
    assert [machine.count(w.encode()) for w in words] == theirs(library, words)


def test_chunk_maps_compose(counter):
    r = np.random.default_rng(3)
    classes = r.integers(0, tokencount.CLASSES, 5000).astype(np.uint8)
    whole = counter.split.marks(classes, 5000)
    for chunk in (1, 7, 64, 999):
        assert (counter.split.marks(classes, chunk) == whole).all()


def test_query(spark, table_dir, frame, library):
    rows = [(i, t, "en", "s") for i, t in enumerate(TEXTS)] + [(None, "null id", None, None), (500, None, None, None), (1, "a", "en", "s")]
    got = QUERIES["op10_token_counts"](spark, table_dir(documents=frame(rows))).collect()
    want = [(i, len((t or "").encode()), n, n > 1024) for (i, t, _, _), n in zip(rows, theirs(library, [t or "" for _, t, _, _ in rows]))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert QUERIES["op10_token_counts"](spark, table_dir(documents=frame([]))).count() == 0


def test_seams_equal_encoding(counter):
    r = random.Random(4)
    m = counter.merge
    assert m.learned and all(m.whole[i] for i, t in enumerate(m.tokens) if t)
    ids = [i for i, t in enumerate(m.tokens) if t]
    pairs = [(r.choice(ids), r.choice(ids)) for _ in range(4000)]
    for _ in range(4000):  # neighbours as texts have them
        t = m.tokens[r.choice(ids)] + m.tokens[r.choice(ids)]
        k = r.randrange(1, len(t))
        pairs.append((m.encode(t[:k])[-1], m.encode(t[k:])[0]))
    for a, b in pairs:
        assert m.seam(a, b) == (m.encode(m.tokens[a] + m.tokens[b]) == [a, b]), (m.tokens[a], m.tokens[b])


def test_seams_of_small_vocabularies():
    """All merge lists over two letters: learned ones by seams, any other order by encoding."""
    r = random.Random(5)
    learned = 0
    for _ in range(300):
        tokens, merges = [b"a", b"b"], []
        for _ in range(r.randint(1, 7)):
            x, y = r.randrange(len(tokens)), r.randrange(len(tokens))
            joined = tokens[x] + tokens[y]
            if (x, y) in {(a, b) for a, b, _ in merges} or len(joined) > 8:
                continue
            if joined not in tokens:
                tokens.append(joined)
            merges.append((x, y, tokens.index(joined)))
        if r.random() < 0.3:
            r.shuffle(merges)
        m = tokencount.MergeMachine(tokens, merges)
        learned += m.learned
        for _ in range(60):
            piece = bytes(r.choice(b"ab") for _ in range(r.randint(1, 14)))
            assert m.count(piece) == len(m.encode(piece)), (tokens, merges, piece)
    assert learned > 100


def test_forgetting_pieces_changes_nothing(counter, library, monkeypatch):
    monkeypatch.setattr(tokencount, "MAX_PIECES", 10)
    small = tokencount.Counter(tokencount.compile_tokenizer(PATH))
    texts = ["some words of a text that goes on " * 3, "and again, some other words"]
    assert mine(small, texts) == theirs(library, texts) and len(small.merge.counts) <= 10


def test_settings_that_are_not_compiled_raise(tmp_path):
    import json
    spec = json.load(open(PATH, encoding="utf-8"))
    for change in ({"ignore_merges": True}, {"byte_fallback": True}, {"unk_token": "<unk>"}):
        path = tmp_path / "t.json"
        path.write_text(json.dumps({**spec, "model": {**spec["model"], **change}}), encoding="utf-8")
        with pytest.raises(ValueError, match=next(iter(change))):
            tokencount.compile_tokenizer(str(path))
