import public_tokenizers as P

from skeinbase.llm import tokencount

from .helpers import empty, frame, texts


def brute(word, pieces, byte):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        n = len(word[end - 1].encode())
        options = [(best[end - 1][0] + n * byte, best[end - 1][1] - n)]
        options += [(best[s][0] + pieces[word[s:end]], best[s][1] - 1) for s in range(end) if word[s:end] in pieces]
        best.append(max(options))
    return best[-1][0], -best[-1][1]


def test_rows_match_a_plain_dynamic_programme(spark):
    pieces = tokencount.zipf_pieces(P.path("piece_bpe_32k.model"))
    assert abs(sum(2.718281828459045**p for p in pieces.values()) - 1) < 1e-6
    model = tokencount.Unigram(pieces)
    rows = [(i, t if t is None or len(t) < 900 else t[:900]) for i, t in texts(6)]
    expected = []
    for i, t in rows:
        parts = [brute("▁" + w.decode(), pieces, model.byte) for w in (t or "").encode().split()]
        expected.append((str(i), len(parts), sum(n for _, n in parts), round(sum(s for s, _ in parts), 6)))
    found = tokencount.count_tokens(frame(spark, rows), pieces).collect()
    assert sorted((str(r.id), r.n_words, r.n_tokens, round(r.score, 6)) for r in found) == sorted(expected)
    assert tokencount.count_tokens(empty(spark), pieces).collect() == []


def test_shared_prefixes_are_scored_as_if_alone():
    model = tokencount.Unigram({"a": -1.0, "ab": -1.5, "b": -2.0, "abc": -9.0, "c": -1.0})
    words = sorted(["a", "ab", "abc", "abcab", "abd", "b", "é", ""])
    assert model.counts(words) == [model.counts([w])[0] for w in words]
