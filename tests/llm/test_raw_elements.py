"""Elements whose names begin like raw ones, self-closed ones, and text inside math and object."""

import pytest

from parcelspark.llm.html_trees import parse


@pytest.mark.parametrize(("inside", "want"), [
    ('<video-js id="v">player</video-js>', "before player after"), ("<title-card>card</title-card>", "before card after"),
    ("<audio-player></audio-player>", "before after"), ("<select-menu>menu</select-menu>", "before menu after"),
    ('<svg viewBox="0 0 1 1"/>', "before after"), ("<svg/>", "before after"), ('<svg a="x/"><path d="M0"/><text>no</text></svg>', "before after"),
    ("<math/>", "before after"), ("<math><mi>x</mi><mo>=</mo><mn>2</mn></math>", "before x=2 after"), ("<object data='a'>fallback</object>", "before fallback after"),
    ("<video src='a'>no</video>", "before after"), ("<script>if (a < b) no()</script>", "before after"), ("<svg><g>no", "before"),
])
def test_text_around_raw_elements(inside, want):
    _, blocks = parse(f"<html><body><p>before {inside} after</p></body></html>")
    assert " ".join(text for _, text, _ in blocks) == want
