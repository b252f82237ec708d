"""The controlled vocabulary of masters."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

FIELDS = ("domain", "frequency", "control_type")
#: The keys of a vocabulary file for each field (fixed values).
NAMES = {"domain": "domains", "frequency": "frequencies", "control_type": "control_types"}


@dataclass(frozen=True)
class Vocabulary:
    """Of each field the allowed values, and other spellings with what they stand for."""

    allowed: dict[str, list[str]] = field(default_factory=dict)
    aliases: dict[str, dict[str, str]] = field(default_factory=dict)

    def value(self, name: str, text: str | None) -> str:
        """The allowed value that the text names; ValueError where there is none."""
        text = (text or "").strip()
        text = self.aliases[name].get(text, text)
        if text not in self.allowed[name]:
            raise ValueError(f"{name} {text!r} is not in the controlled vocabulary {self.allowed[name]}")
        return text


def read_vocabulary(path: str) -> Vocabulary:
    """A JSON file with domains, frequencies and control_types, and domain_aliases and so on."""
    with open(path, encoding="utf-8") as f:
        tree = json.load(f)
    return Vocabulary({k: tree[n] for k, n in NAMES.items()}, {k: tree.get(f"{k}_aliases", {}) for k in FIELDS})
