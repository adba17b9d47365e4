import numpy as np

from plumbline.llm import langid


def test_predictions_like_plain_loops(documents):
    """Every window, filter and maximum worked out one by one."""
    rng = np.random.default_rng(0)
    words = {"en": "the and with of that", "de": "der und mit von dass"}
    docs = documents([(i, " ".join(rng.choice(words[l].split(), 30)), l) for i in range(40) for l in words])
    net = langid.fit(docs, langid.Settings(per_language=10, epochs=2))
    texts = ["the and with", "der und " * 60, "x", "ünïcödé und der", "", None, "12 34"]
    names, scores = langid.predict(net, texts)
    for text, name, score in zip(texts, names, scores):
        if not text or not any(c.isalpha() for c in text):
            assert (name, score) == (langid.UNDETERMINED, 0.0)
            continue
        cuts = langid.cut(text.encode(), 128)
        total, weight = np.zeros(len(net.languages)), 0
        for window in cuts:
            size = int((np.asarray(window) > 0).sum())
            total += size * plain(net, np.asarray(window))
            weight += size
        mean = total / weight
        assert name == net.languages[int(mean.argmax())] and abs(score - mean.max()) < 1e-4


def plain(net, window):
    embedded = np.array([net.embedding[b] for b in window], float)
    width = net.filters.shape[0] // net.embedding.shape[1] if net.filters.ndim == 2 else net.filters.shape[0]
    best = np.full(net.bias.shape, -np.inf)
    kernel = np.asarray(net.filters, float).reshape(width * net.embedding.shape[1], -1)
    for start in range(len(window) - width + 1):
        best = np.maximum(best, embedded[start : start + width].reshape(-1) @ kernel + net.bias)
    out = np.maximum(best, 0) @ np.asarray(net.out, float) + net.out_bias
    powers = np.exp(out - out.max())
    return powers / powers.sum()


def test_languages_are_bounded_by_their_labels(documents):
    rows = [(i, "aaa bbb", "many") for i in range(9)] + [(20 + i, "ccc", "some") for i in range(5)] + [(40, "ddd", "few"), (41, "eee", "alsofew")]
    net = langid.fit(documents(rows), langid.Settings(languages=3, epochs=1))
    assert net.languages == ["alsofew", "many", "some"]
