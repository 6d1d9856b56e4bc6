"""Ids of tokenizer files, with runs of any length.

A plain byte-level BPE file whose ids follow its merges is run by a faster library over the same vocabulary, with the same ids.
"""

import json
import re

#: The pattern that cuts a text before byte-level BPE, as in the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# A run of white space is one piece, but for its last character before a word. The pattern above steps back over such a
# run and gives up on very long ones, so those are cut out first.
_LONG_BLANK = re.compile("[\t-\r \x85\xa0  -     　]{1000,}")


def bytes_of_symbols() -> dict[str, int]:
    """Byte-level symbols: printable bytes stand for themselves, the others for characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _fast(spec: dict):
    """The fast library's encoder for a tokenizer file, or None if the file asks for more than plain byte-level BPE."""
    before, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if not (
        model["type"] == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex") and not before["add_prefix_space"]
        and not spec.get("normalizer") and not any(model.get(k) for k in ("dropout", "unk_token", "byte_fallback", "ignore_merges"))
    ):
        return None
    byte, special = bytes_of_symbols(), {x["content"] for x in spec["added_tokens"]}
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(merged) or not all(set(x) <= set(byte) for x in model["vocab"] if x not in special):
        return None
    import tiktoken

    ranks = {bytes(byte[c] for c in x): i for x, i in model["vocab"].items() if x not in special}
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        out, at = [], 0
        for run in _LONG_BLANK.finditer(text):
            stop = run.end() - (run.end() < len(text))
            out += own.encode_ordinary(text[at:run.start()])
            out += own._encode_single_piece(text[run.start():stop].encode())
            at = stop
        return out + own.encode_ordinary(text[at:])

    return encode


def encoder(path: str, special: bool):
    """Text -> list of ids, without the tokens that a tokenizer adds around a text.

    ``special``: strings of the file's special tokens in a text become those tokens, as in the tokenizer's plain call;
    else they are ordinary text.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    fast = _fast(spec)
    added = {x["content"]: x for x in spec["added_tokens"]}
    if fast is None or special and any(x[k] for x in added.values() for k in ("single_word", "lstrip", "rstrip", "normalized")):
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)
        slow.encode_special_tokens = not special
        return lambda text: slow.encode(text, add_special_tokens=False).ids
    if not special or not added:
        return fast
    cuts = re.compile("(" + "|".join(re.escape(x) for x in sorted(added, key=len, reverse=True)) + ")")

    def encode(text: str) -> list[int]:
        out = []
        for i, part in enumerate(cuts.split(text)):
            out += [added[part]["id"]] if i % 2 else fast(part)
        return out

    return encode


def byte_level_bytes(path: str) -> list[bytes]:
    """The bytes of every id of a byte-level file; special tokens stand for their strings."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    byte, special = bytes_of_symbols(), {x["id"]: x["content"].encode() for x in spec["added_tokens"]}
    vocabulary = {i: bytes(byte[c] for c in x) for x, i in spec["model"]["vocab"].items() if i not in special} | special
    return [vocabulary.get(i, b"") for i in range(max(vocabulary) + 1)]
