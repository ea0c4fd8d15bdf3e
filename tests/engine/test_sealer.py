"""Keys of a sealer are derived once, not for every row."""

from __future__ import annotations

from duneveil.operators import tokens


def test_keys_are_derived_once(monkeypatch):
    used, key = [], tokens.Sealer._key
    monkeypatch.setattr(tokens.Sealer, "_key", lambda self, use: used.append(use) or key(self, use))
    sealer = tokens.Sealer("share", "data", 1, b"a key for tests")
    assert [sealer.open(sealer.seal(tokens.pack(0, str(k)))) for k in range(50)] == [(0, str(k)) for k in range(50)]
    assert sorted(used) == ["stream", "tag"]
