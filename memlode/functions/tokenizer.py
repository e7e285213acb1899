"""Tokenizers from a tokenizer.json: normalizers, pre-tokenizers, four models, special tokens, truncation and padding."""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA = "input_ids array<bigint>, attention_mask array<bigint>, token_type_ids array<bigint>"


def _bert_words(text: str) -> list[str]:
    return re.findall(r"[^\w\s]|_|[^\W_]+", text)


@dataclass
class Tokenizer:
    """encode(text) gives ids; window(text) the padded triple of a model's input."""

    kind: str
    vocab: dict[str, int]
    unknown: str | None = None
    ranks: dict[tuple[str, str], int] = field(default_factory=dict)
    normalizers: list[dict] = field(default_factory=list)
    splitters: list[dict] = field(default_factory=list)
    first: str = "[CLS]"
    last: str = "[SEP]"
    pad: str = "[PAD]"
    prefix: str = "##"
    length: int = 128

    def normalize(self, text: str) -> str:
        for step in self.normalizers:
            kind = step.get("type")
            if kind in ("NFC", "NFD", "NFKC", "NFKD"):
                text = unicodedata.normalize(kind, text)
            if kind == "Lowercase" or (kind == "BertNormalizer" and step.get("lowercase", True)):
                text = text.lower()
            strip = step.get("strip_accents")
            if kind == "StripAccents" or (kind == "BertNormalizer" and (strip if strip is not None else step.get("lowercase", True))):
                text = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
            if kind == "Strip":
                text = text.strip()
        return text

    def split(self, text: str) -> list[str]:
        parts = [text]
        for step in self.splitters or [{"type": "WhitespaceSplit"}]:
            kind = step.get("type")
            if kind == "BertPreTokenizer":
                cut = _bert_words
            elif kind == "Whitespace":
                cut = lambda s: re.findall(r"\w+|[^\w\s]+", s)
            elif kind == "Punctuation":
                cut = lambda s: re.findall(r"[^\w\s]|[\w\s]+", s)
            elif kind == "Metaspace":
                cut = lambda s: ["▁" + w for w in s.split()]
            elif kind == "Split":
                pattern = step.get("pattern", {})
                expression = pattern.get("Regex") or re.escape(pattern.get("String", " "))
                cut = lambda s, e=expression: [w for w in re.split(e, s) if w]
            else:
                cut = str.split
            parts = [w for p in parts for w in cut(p) if w.strip()]
        return parts

    def _greedy(self, word: str, prefix: str) -> list[str]:
        out, at = [], 0
        while at < len(word):
            for end in range(len(word), at, -1):
                piece = (prefix if at else "") + word[at:end]
                if piece in self.vocab:
                    out.append(piece)
                    at = end
                    break
            else:
                if self.kind == "WordPiece":
                    return [self.unknown] if self.unknown else []
                out.append(self.unknown or word[at])
                at += 1
        return out

    def pieces(self, word: str) -> list[str]:
        if self.kind == "WordPiece":
            return self._greedy(word, self.prefix)
        if self.kind == "Unigram":
            return self._greedy(word, "")
        if self.kind == "BPE":
            parts = list(word)
            while len(parts) > 1:
                rank, i = min((self.ranks.get(pair, 1 << 60), i) for i, pair in enumerate(zip(parts, parts[1:])))
                if rank == 1 << 60:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            return parts
        return [word]

    def encode(self, text: str) -> list[int]:
        unknown = self.vocab.get(self.unknown) if self.unknown else None
        ids = [self.vocab.get(p, unknown) for w in self.split(self.normalize(text)) for p in self.pieces(w)]
        return [i for i in ids if i is not None]

    def window(self, text: str) -> tuple[list[int], list[int], list[int]]:
        ids = self.encode(text)[: self.length - 2]
        ids = [i for i in (self.vocab.get(self.first), *ids, self.vocab.get(self.last)) if i is not None]
        rest = self.length - len(ids)
        return ids + [self.vocab.get(self.pad, 0)] * rest, [1] * len(ids) + [0] * rest, [0] * self.length


def load(source: str | dict, length: int = 128) -> Tokenizer:
    """A tokenizer from the text or the object of a tokenizer.json; without a type the model is told by its parts."""
    spec = json.loads(source) if isinstance(source, str) else source
    model = spec.get("model", {})
    raw = model.get("vocab", {})
    vocab = dict(raw) if isinstance(raw, dict) else {row[0]: i for i, row in enumerate(raw)}
    for token in spec.get("added_tokens", []):
        vocab[token["content"]] = token["id"]
    kind = model.get("type") or ("BPE" if model.get("merges") else "Unigram" if isinstance(raw, list) else "WordPiece")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
    steps = lambda x, key: [] if not x else [s for p in x[key] for s in steps(p, key)] if x.get("type") == "Sequence" else [x]
    unknown = model.get("unk_token") or (raw[model["unk_id"]][0] if isinstance(raw, list) and model.get("unk_id") is not None else None)
    ends = ("[CLS]", "[SEP]", "[PAD]") if "[CLS]" in vocab else ("<s>", "</s>", "<pad>")
    return Tokenizer(kind, vocab, unknown, {m: i for i, m in enumerate(merges)}, steps(spec.get("normalizer"), "normalizers"), steps(spec.get("pre_tokenizer"), "pretokenizers"), *ends, prefix=model.get("continuing_subword_prefix") or "##", length=length)


def tokenize(tokenizer: Tokenizer, text: Column) -> Column:
    """struct(input_ids, attention_mask, token_type_ids); a null text counts as empty."""

    @F.pandas_udf(SCHEMA)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [tokenizer.window(t or "") for t in texts]
        return pd.DataFrame(rows, columns=["input_ids", "attention_mask", "token_type_ids"])

    return run(text)
