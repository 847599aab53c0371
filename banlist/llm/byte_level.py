"""What byte-level tokenizer files have in common."""

from __future__ import annotations

import json

from banlist.llm.workers import ship

ship(__name__)

# The split patterns of the tokenizer files.
BYTE_LEVEL_SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the files: itself
    where it is printable in Latin-1, else the next unused one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def load(path: str) -> dict:
    """The tokenizer file, refused if it asks for what is not built here."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = spec["model"]
    unknown = [
        key
        for key in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")
        if model.get(key)
    ]
    if model.get("type") != "BPE" or unknown:
        raise ValueError(f"{path}: not a plain BPE model: {unknown}")
    for token in spec["added_tokens"]:
        if token["normalized"] or token["lstrip"] or token["rstrip"] or token["single_word"]:
            raise ValueError(f"{path}: added token {token['content']!r} has options")
    return spec


def pairs(spec: dict) -> list[tuple[str, str]]:
    return [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]


def cut_out(text: str, specials: list[str]) -> list[tuple[str, bool]]:
    """The text as (part, is it a special string), leftmost and then longest first."""
    if not any(s in text for s in specials):
        return [(text, False)]
    import regex

    parts = regex.split("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")", text)
    return [(part, i % 2 == 1) for i, part in enumerate(parts) if part]
