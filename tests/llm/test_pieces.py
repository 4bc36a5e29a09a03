"""The table of pieces with known ids is bounded, and keeps what comes often."""

from collections import Counter

from cohortweave.llm import bpe


def test_pieces_asked_for_often_outlast_the_table(monkeypatch):
    monkeypatch.setattr(bpe, "TABLE_PIECES", 40)
    tool = bpe.Encoder(bpe.public_tokenizers.path(bpe.DEFAULT_VOCABULARY))
    made, own = Counter(), tool._encoded
    table = tool._known
    table._make = lambda piece: made.update([piece]) or own(piece)
    for i in range(300):
        text = f" often rare{i}x"
        assert tool.ids(text) == tool._whole.encode(text, add_special_tokens=False).ids
        assert len(table) + len(table._older) <= 40
    assert made[" often"] <= 300 * 3 // 20 + 1  # at most once each time a half is full, far from each text
    assert made[" often"] < 30
