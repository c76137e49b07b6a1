"""Token ids of whole texts by the tokenizers library, with repeated words encoded once.

The word vocabulary drops white space, so a text's ids are those of its space-separated
chunks in a row. Chunks are kept in a bounded memo. Plain chunks (Latin letters, then
punctuation) go straight to the library's model; all others through its whole chain.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Fixed value: the splitting pattern of the word vocabulary, for which chunks are independent.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters whose lower case and composed form are one and the same letter in every library, and ASCII punctuation but the apostrophe.
PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]*")
PUNCTUATION = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum() and chr(i) != "'")
CHUNK_LIMIT, MEMO_LIMIT, BLOCK_CHARS = 64, 250_000, 2_000_000


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others for code points from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Ids of whole texts. Chunks of Latin letters and trailing punctuation are put together from
    remembered parts; other chunks are remembered as a whole. The memos are bounded."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        steps = (told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        norms = [x["type"] for x in (told.get("normalizer") or {}).get("normalizers", [])]
        self.by_word = norms == ["NFC", "Replace", "Lowercase"] and steps[0].get("pattern", {}).get("Regex") == WORD_PATTERN \
            and all(x["content"].startswith("<|") and " " not in x["content"] and not x["lstrip"] and not x["rstrip"] for x in told["added_tokens"])
        self.letters = _byte_letters()
        self.parts: dict[str, bytes] = {"": b""}  # lower-case words and runs of punctuation
        self.old_parts: dict[str, bytes] = {}  # what was remembered before the last change of generation
        self.others: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _part(self, part: str) -> bytes:
        got = self.parts.get(part)
        if got is None:
            got = self.old_parts.get(part)
            if got is None:
                mapped = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
                got = array("I", [t.id for t in self.tokenizer.model.tokenize(mapped)]).tobytes()
            if len(self.parts) >= MEMO_LIMIT:
                self.old_parts, self.parts = self.parts, {"": b""}
            if len(part) <= CHUNK_LIMIT:
                self.parts[part] = got
        return got

    def _other(self, chunk: str) -> bytes:
        got = self.others.get(chunk)
        if got is None:
            got = self._whole(chunk)
            if len(self.others) >= MEMO_LIMIT // 4:
                self.others.clear()
            if len(chunk) <= CHUNK_LIMIT:
                self.others[chunk] = got
        return got

    def chunks(self, chunks) -> list[bytes]:
        """Ids of each chunk, as little-endian unsigned 32-bit numbers."""
        out = []
        for chunk in chunks:
            word = chunk.rstrip(PUNCTUATION)
            got = self.parts.get(word.lower())
            if got is None:
                if not PLAIN.fullmatch(word):
                    out.append(self._other(chunk))
                    continue
                got = self._part(word.lower())
            out.append(got if len(word) == len(chunk) else got + self._part(chunk[len(word):]))
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text; null is an empty text."""
        return self.encode_batch([text])[0].tobytes()

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each whole text. The distinct chunks of a block of texts are looked up once."""
        texts = [t or "" for t in texts]
        if not self.by_word:
            return [np.frombuffer(self._whole(t), "<u4") for t in texts]
        out: list[np.ndarray] = []
        block: list[str] = []
        held = 0
        for t in texts:
            block.append(t)
            held += len(t)
            if held > BLOCK_CHARS:
                out += self._block(block)
                block, held = [], 0
        return out + self._block(block)

    def _block(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        chunks = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
        coded = chunks.values.dictionary_encode()
        code = coded.indices.to_numpy()
        known = self.chunks(coded.dictionary.to_numpy(zero_copy_only=False))
        flat = np.frombuffer(b"".join(known), "<u4")
        length = np.fromiter(map(len, known), np.int64, len(known)) // 4
        first = np.cumsum(length) - length
        each = length[code]
        ends = np.cumsum(each)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(first[code] - (ends - each), each) + np.arange(total)]
        at = np.concatenate([[0], ends])[chunks.offsets.to_numpy()]
        del chunks, coded
        pa.default_memory_pool().release_unused()
        return [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


_made: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _made:
        _made[path] = WordEncoder(path)
    return _made[path]
