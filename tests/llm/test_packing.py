import random
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillspark.llm import packing


def _best_fit(lengths, capacity):
    gaps, opened = [], 0
    for n in sorted(lengths, reverse=True):
        i = bisect_left(gaps, n)
        if i < len(gaps):
            gap = gaps.pop(i) - n
        else:
            gap, opened = capacity - n, opened + 1
        if gap:
            insort(gaps, gap)
    return opened


@pytest.mark.parametrize("lengths", [lambda r: int(r.lognormvariate(5.8, 1.2)) % 4096 + 1, lambda r: r.randint(1, 4096), lambda r: r.randint(700, 1500), lambda r: r.randint(1, 9)])
def test_rounds_are_as_good_as_best_fit(lengths):
    rnd = random.Random(5)
    counts = Counter(lengths(rnd) for _ in range(3000))
    sequences, ranks = defaultdict(list), defaultdict(list)
    for n, rank, number, first, offset in packing.rounds(counts):
        ranks[n] += range(rank, rank + number)
        for j in range(number):
            sequences[first + j].append((offset, n))
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
    for held in sequences.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= 4096
    assert len(sequences) <= _best_fit(counts.elements(), 4096) * 1.005 + 1


def test_pieces_and_places(docs_of):
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choice(["thing", "the", "é,", "12!", "Ñandú", "<|endoftext|>"]) for _ in range(rnd.randint(0, 700)))) for i in range(200)]
    rows += [(1000, None), (1001, ""), (1002, "word, Word! " * 9000), (1003, "same"), (1003, "same")]
    got = packing.pack(docs_of(rows)).collect()
    tokenizer = packing.WordIds(packing._default_vocabulary()).tokenizer
    want = Counter()
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            own = ids[k : k + 4096]
            want[i, k // 4096, k, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for own in held.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 4096
    assert packing.pack(docs_of([(1, "x")]).limit(0)).count() == 0


def test_words_are_tokenized_as_whole_texts():
    rnd, ids = random.Random(1), packing.WordIds(packing._default_vocabulary(), kept=50)
    texts = ["".join(rnd.choice("ab1é'ß,.!<|> \n\t́Σİ\x85_-sS²") for _ in range(60)) for _ in range(2000)] + ["it's 've!? x<|endoftext|>... <|startoftext|>,x"]
    for i in range(0, len(texts), 100):
        for text, made in zip(texts[i : i + 100], ids.ids(texts[i : i + 100]), strict=True):
            assert np.frombuffer(made, "<u4").tolist() == ids.tokenizer.encode(text, add_special_tokens=False).ids
