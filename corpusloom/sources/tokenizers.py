"""Parts of tokenizers by name, special tokens, saving. Vocabularies come from files; none is trained here."""

from __future__ import annotations

import json
from pathlib import Path

from corpusloom.functions.cleaning import TOKENS

# fixed values: the base tokens of a diff tokenizer
BASE = ("[PAD]", "[UNK]", "[BOS]", "[EOS]", "[SEP]", "[MASK]")


def tokenizer_tokens(line_sep: str = "[NL]", messages: bool = False) -> list[str]:
    """Special tokens: the base ones, line ends, the mark of what is too long and, for messages, what stands for removed things."""
    return [*BASE, line_sep, "\n", "[LONG]", *(TOKENS.values() if messages else ())]


def make(kind: str, spec: dict | None):
    """A normalizer, pre-tokenizer, decoder or model from {"type": name, **arguments}; None for no part."""
    import tokenizers

    if not spec:
        return None
    known = {"model": tokenizers.models, "normalizer": tokenizers.normalizers, "pre_tokenizer": tokenizers.pre_tokenizers, "decoder": tokenizers.decoders}
    if kind not in known:
        raise ValueError(f"unknown part {kind!r}: one of {tuple(known)}")
    arguments = dict(spec)
    maker = getattr(known[kind], arguments.pop("type"), None)
    if maker is None:
        raise ValueError(f"unknown {kind} {spec['type']!r}")
    return maker(**arguments)


def build_tokenizer(configuration: str = "byte_level", vocabulary: str | None = None, line_sep: str = "[NL]", messages: bool = False, **parts):
    """A tokenizer around the vocabulary of a tokenizer file: ``byte_level``, or ``custom`` with its parts given as for :func:`make`."""
    from tokenizers import Tokenizer

    if configuration == "byte_level":
        parts = {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}, "decoder": {"type": "ByteLevel"}}
    elif configuration != "custom":
        raise ValueError(f"unknown configuration {configuration!r}: byte_level or custom")
    tokenizer = Tokenizer.from_file(vocabulary) if vocabulary else Tokenizer(make("model", parts.get("model") or {"type": "BPE", "unk_token": "[UNK]"}))
    for kind in ("normalizer", "pre_tokenizer", "decoder"):
        if parts.get(kind):
            setattr(tokenizer, kind, make(kind, parts[kind]))
    tokenizer.add_special_tokens(tokenizer_tokens(line_sep, messages))
    return tokenizer


def save_tokenizer(tokenizer, folder: str, line_sep: str = "[NL]", messages: bool = False) -> None:
    """diff_tokenizer.json, and beside it the roles of the special tokens."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    tokenizer.save(f"{folder}/diff_tokenizer.json", pretty=True)
    roles = {"bos_token": "[BOS]", "cls_token": "[BOS]", "eos_token": "[EOS]", "mask_token": "[MASK]", "pad_token": "[PAD]", "sep_token": "[SEP]", "unk_token": "[UNK]"}
    extra = [t for t in tokenizer_tokens(line_sep, messages) if t not in BASE]
    Path(folder, "special_tokens_map.json").write_text(json.dumps(roles | {"additional_special_tokens": extra}, indent=2))
