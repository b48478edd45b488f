"""A learned span that is longer than a pattern's stays beside it."""

import numpy as np

from parcelspark.llm import crf_secrets


def test_field_span_around_a_base_span(monkeypatch):
    draw = np.random.default_rng(3)
    features, tags = np.zeros((300, 12, 7), np.int16), np.full((300, 12), crf_secrets.OUTSIDE)
    for k in range(300):
        parts = ["plain"] * 12
        at = int(draw.integers(2, 11))
        parts[at] = "".join(draw.choice(list("ABCDEFabcdef0123456789"), 30))
        features[k] = crf_secrets.tokens_of([" ".join(parts)]).features
        tags[k, at] = crf_secrets.BEGIN
    model = crf_secrets.fit(features, tags, np.ones((300, 12), bool))
    text = "some plain text with Ab3Cd9eF00aB12cD34eF56aB78cD90 inside of it"
    monkeypatch.setattr(crf_secrets, "base_spans", lambda text: [(25, 40, 2)])
    spans = crf_secrets.find_spans([text], model)[0]
    assert spans == [(21, 51, 3), (25, 40, 2)]
    assert crf_secrets.redact(text, spans) == "some plain text with [SECRET] inside of it"
    monkeypatch.setattr(crf_secrets, "base_spans", lambda text: [(21, 51, 2)])
    assert crf_secrets.find_spans([text], model)[0] == [(21, 51, 2)]
