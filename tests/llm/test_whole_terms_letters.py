"""Identity terms as whole words, neutral mentions, texts without a letter, many siblings."""

import numpy as np

from parcelspark.llm import html_trees, langid, toxicity


def margin(model, text):
    weights = dict(zip(model.places.tolist(), model.weights))
    return model.bias + sum(weights.get(f, 0.0) for f in toxicity.features_of(text))


def test_only_whole_words_are_identity_terms():
    terms = set(toxicity.TERM_PLACE.values())
    assert min(terms) >= 1 << toxicity.BITS and len(terms) == len(toxicity.TERM_PLACE)
    for word in ("atheon", "onering", "thernd", "womens", "he's", "Hex", "mannheim"):
        assert not toxicity.features_of(word) & terms
    for word in ("Women,", "(he)", "männer", "judíos."):
        assert len(toxicity.features_of(word)) == 1 and toxicity.features_of(word) <= terms


def test_neutral_mentions_keep_their_score():
    """Half of the toxic texts name one group; the penalty leaves the insult the weight and the group little, at no cost in errors."""
    draw = np.random.default_rng(5)
    words = [f"plain{k}" for k in range(60)]
    texts, labels = [], []
    for n in range(1200):
        toxic = n % 5 == 0
        own = list(draw.choice(words, 8))
        if toxic:
            own.append(str(draw.choice(["vileword", "nastyword"])))
        if draw.random() < (0.5 if toxic else 0.02):
            own.append("muslims")
        texts.append(" ".join(own))
        labels.append(int(toxic))
    rows = [np.array(sorted(toxicity.features_of(text))) for text in texts]
    labels = np.array(labels)
    fair, plain = toxicity.fit(rows, labels), toxicity._fit(rows, labels, 4e-4 / 20, fairness=0.0)
    move = lambda model: abs(margin(model, "plain1 muslims") - margin(model, "plain1"))
    assert move(fair) < 0.5 < 1 < move(plain)
    said = np.array([margin(fair, text) >= 0 for text in texts])
    assert said[labels == 1].mean() == 1 and said[labels == 0].mean() == 0


def test_number_signs_are_no_letters():
    for text in ("½", "² ³ 12", "Ⅷ", "_", "—"):
        assert not langid.LETTER.search(text)
    for text in ("a", "é1", "中", "ª"):
        assert langid.LETTER.search(text)


def test_siblings_are_counted_by_tag_at_any_number():
    for many in (150, 250):
        nodes, blocks = html_trees.parse("<body>" + "<p>one</p>" * 3 + "<div>two</div>" * many + "</body>")
        rows = html_trees.features(nodes, blocks)
        like = 2 * len(html_trees.LEXICON) + len(html_trees.TAGS) + html_trees.SEMANTIC + 10
        assert {float(row[like]) for row, node in zip(rows, nodes) if node.tag == "p"} == {3.0}
        assert {float(row[like]) for row, node in zip(rows, nodes) if node.tag == "div"} == {float(many)}
