"""Which tokenizer files are encoded word by word."""

import json

from ledgerspark.llm import packing, queries


def test_special_tokens_with_space(tmp_path):
    """A special token over a space can only be met in the whole text, so such a file isn't split into words."""
    path = queries.tokenizer_path()
    assert packing.word_wise(path)
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    for content, wise in (("<|one|>", True), ("<|two words|>", False), ("<|line\nend|>", False)):
        own = tmp_path / "t.json"
        special = {"id": 90_000, "content": content, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
        own.write_text(json.dumps(d | {"added_tokens": [*(d.get("added_tokens") or []), special]}))
        assert packing.word_wise(str(own)) == wise
