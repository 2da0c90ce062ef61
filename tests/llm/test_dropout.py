"""Merge-dropout is drawn for every occurrence of a word."""

from collections import Counter

import numpy as np
from test_brute import documents

from skein.llm import pieces
from skein.llm.queries import PIECE_MODEL, tokenizer_path


def drawn(coder, chunks, base):
    flat, sizes = coder._drawn(chunks, base)
    return [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])]


def plain(coder, chunk, draws):
    """Merge-dropout as it is told: the best candidate comes up, is dropped or merged."""
    symbols, dropped, draws, step = list(chunk), set(), set(draws), 0
    known = lambda x: x in coder.score
    while True:
        spans, at = [], 0
        for x in symbols:
            spans.append(at)
            at += len(x)
        open_ = [
            (coder.score[a + b], spans[i], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False))
            if known(a) and known(b) and known(a + b) and (spans[i], a, b) not in dropped
        ]
        if not open_:
            return [i for x in symbols for i in ([coder.ids[x]] if known(x) else [coder.byte[b] for b in x.encode("utf-8", "surrogatepass")])]
        _, start, i = min(open_)
        if step in draws:
            dropped.add((start, symbols[i], symbols[i + 1]))
        else:
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        step += 1


def draws_of(coder, base, limit):
    """The draws as they are told: the k-th geometric gap from the k-th hash of the seed."""
    return list(coder._draws(int(base), limit))


def test_occurrences_are_drawn_anew(spark):
    path = tokenizer_path(PIECE_MODEL)
    coder = pieces.Codec(path, 0.1, 13)
    word = "information"
    alone = pieces.Codec(path).encode(word)
    coder.encode(word)
    steps = int(coder.states[2, coder.roots[pieces.MARK + word]])
    n = 5000
    within = Counter(map(tuple, drawn(coder, [pieces.MARK + word] * n, pieces._mixed_all(np.arange(n, dtype=np.uint64)))))
    across = Counter(map(tuple, coder.encode_all([word] * n, list(range(n)))))
    for found in (within, across):
        assert len(found) > 4 and found[tuple(alone)] > 0.9**steps * n * 0.9
    text = " ".join([word] * n)
    ids = coder.encode(text, 7)
    assert coder.decode(ids) == text and len(ids) > n * len(alone)
    # A word of few steps escapes in about the share of occurrences that the rate gives.
    free = sum(1 for base in range(n) if next(coder._draws(pieces._mixed(base * 77 + 1), 1000)) >= 2)
    assert abs(free / n - 0.81) < 0.03


def test_a_long_word_has_hundreds_of_segmentations():
    coder = pieces.Codec(tokenizer_path(PIECE_MODEL), 0.3, 9)
    assert len(set(map(tuple, coder.encode_all([" international"] * 2000, list(range(2000)))))) > 150


def test_kept_states_follow_the_plain_rule(spark):
    path = tokenizer_path(PIECE_MODEL)
    texts = [r["text"] for r in documents(spark).limit(60).collect()] + ["é日本𝄞日é x", "\ud800 a", "▁a▁ b", "a" * 40]
    coder = pieces.Codec(path, 0.3, 9)
    together = coder.encode_all(texts, list(range(len(texts))))
    assert any(len(coder.drops_of(s)) > 2 for s in range(coder.states.shape[1]))
    chunk_of = {tuple(coder.states[3:5, s].tolist()): c for c, s in coder.roots.items()}
    for s in range(1, coder.states.shape[1], 23):
        chunk, drops = chunk_of[tuple(coder.states[3:5, s].tolist())], coder.drops_of(s)
        assert coder._heap(chunk, drops) == coder.ids_of(s) == plain(coder, chunk, drops)
    # What is kept or batched does not matter.
    assert together == [pieces.Codec(path, 0.3, 9).encode(t, i) if i < 5 else ids for i, (t, ids) in enumerate(zip(texts, together, strict=True))]
    # The drops of a kept state are those that the occurrence draws.
    chunks = [c for c in coder.roots if c][:300]
    base = pieces._mixed_all(np.arange(300, dtype=np.uint64))[: len(chunks)]
    assert drawn(coder, chunks, base) == [plain(coder, c, draws_of(coder, b, 3 * len(c))) for c, b in zip(chunks, base, strict=True)]
    assert pieces.Codec(path, 1.0, 1).encode("information") == [coder.ids[c] for c in "▁information"]


def test_long_chunks_follow_the_plain_rule():
    coder = pieces.Codec(tokenizer_path(PIECE_MODEL), 0.2, 4)
    for chunk in ("▁" + "internationalisation" * 6, "▁" * 70, "▁" + "日本語é" * 20):
        assert drawn(coder, [chunk, "▁a", chunk], np.array([5, 6, 7], np.uint64)) == [plain(coder, c, draws_of(coder, b, 3 * len(c))) for c, b in ((chunk, 5), ("▁a", 6), (chunk, 7))]


def test_pieces_of_characters_that_are_none():
    coder = pieces.Codec(tokenizer_path(PIECE_MODEL), 0.5, 4)
    coder.score["日𝄞"], coder.ids["日𝄞"] = 0.0, coder.ids["▁a"]
    del coder.score["日"], coder.ids["日"]
    assert coder._heap("▁日𝄞" + "x" * 60)
