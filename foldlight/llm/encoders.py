"""Public tokenizers behind one interface: token ids or token counts of a batch of texts.

``.json`` files are read by tokenizers, ``.model`` files by sentencepiece.
A ``.json`` file that holds plain byte-level BPE with the common split pattern
gives the same ids through tiktoken, which is about four times faster: the
vocabulary is turned into ranks and the file's special tokens are parsed inside
texts as tokenizers does. The two agree on every character (tested), because a
pair of finished tokens whose bytes form a vocabulary entry is always the pair
that the file lists for that entry.
"""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Callable

import numpy as np
import public_tokenizers
from pyspark import cloudpickle

from foldlight.llm.words import kept

cloudpickle.register_pickle_by_value(sys.modules[__name__])

Ids = Callable[[list[str]], list[np.ndarray]]


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _plain_ranks(spec: dict) -> dict[bytes, int] | None:
    """Ranks of a plain byte-level BPE file, else None."""
    model = spec["model"]
    split = spec.get("pre_tokenizer") or {}
    plain = (
        model.get("type") == "BPE"
        and not spec.get("normalizer")
        and split.get("type") == "ByteLevel"
        and split.get("use_regex", True)
        and not split.get("add_prefix_space")
        and not any(model.get(k) for k in ("dropout", "unk_token", "byte_fallback", "ignore_merges"))
        and not any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix"))
        and not any(t[k] for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word"))
    )
    if not plain:
        return None
    special = {t["content"] for t in spec["added_tokens"]}
    letters = byte_letters()
    ranks = {
        bytes(letters[c] for c in word): i for word, i in model["vocab"].items() if word not in special
    }
    made = [
        model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]
    ]
    return ranks if made == sorted(set(made)) and len(ranks) == 256 + len(made) else None


def splits_at_spaces(path: str) -> bool:
    """Whether the file's split pattern is the common one, whose safe boundaries are known."""
    if not path.endswith(".json"):
        return False

    def plain() -> bool:
        with open(path, encoding="utf-8") as file:
            return _plain_ranks(json.load(file)) is not None

    return kept(f"splits {path}", plain)


def _open(path: str) -> Ids:
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [np.array(x, np.uint32) for x in pieces.encode(texts, num_threads=1)]
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    ranks = _plain_ranks(spec)
    if ranks is None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda texts: [
            np.array(x.ids, np.uint32)
            for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ]
    import tiktoken

    ranked = tiktoken.Encoding(
        "ranked",
        pat_str=public_tokenizers.PATTERN,
        mergeable_ranks=ranks,
        special_tokens={t["content"]: t["id"] for t in spec["added_tokens"]},
    )
    special = list(ranked.special_tokens_set)

    def ids(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return ranked.encode_to_numpy(text, allowed_special="all")
        return ranked.encode_to_numpy(text, disallowed_special=())

    return lambda texts: [ids(t) for t in texts]


def encoder(path: str) -> Ids:
    """A function from texts to their token ids, without added special tokens."""
    return kept(f"encoder {path}", lambda: _open(path))
