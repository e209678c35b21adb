from tessera.llm import token_counts as T


def brute(model, word):
    """The best segmentation of a word on its own."""
    text = "▁" + word
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        n = len(text[end - 1].encode())
        s, t = best[end - 1][0] + n * model.byte, best[end - 1][1] + n
        for start in range(end):
            p = model.score.get(text[start:end])
            if p is not None and (best[start][0] + p > s or (best[start][0] + p == s and best[start][1] + 1 < t)):
                s, t = best[start][0] + p, best[start][1] + 1
        best.append((s, t))
    return best[-1][1]


def test_shared_prefixes_change_nothing(sample):
    model = T.Unigram()
    texts = {r.doc_id: r.text or "" for r in sample.limit(60).collect()}
    words = {w for t in texts.values() for w in t.split()} | {"日本語", "a", "aa", "aab", "ab", "\U0001f600x"}
    counts = dict(model.count(sorted(words)))
    assert counts == {w: brute(model, w) for w in words}


def test_documents(sample):
    model = T.Unigram()
    for r in T.token_counts(sample.limit(20)).join(sample, "doc_id").collect():
        words = r.text.encode().split()
        assert r.n_pretokens == len(words)
        assert r.n_tokens == sum(brute(model, w.decode()) for w in words)


def test_a_small_store_changes_nothing(sample):
    rows = lambda k: sorted(map(tuple, T.token_counts(sample, keep=k).collect()))
    assert rows(10) == rows(T.KEEP)


def test_edges(edge_docs, no_docs):
    found = {r.doc_id: r for r in T.token_counts(edge_docs).collect()}
    assert found[1].n_tokens == found[2].n_tokens == found[3].n_tokens == 0
    assert found[13].n_pretokens == 400
    assert T.token_counts(no_docs).count() == 0
