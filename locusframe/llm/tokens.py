"""Token ids of whole texts by a public tokenizer, for use inside tasks."""

from __future__ import annotations

import os
import re
import struct

import numpy as np

#: A piece is a run of blanks with the text after it. Both tokenizers cut before
#: a blank that follows another character, so pieces can be encoded alone.
PIECES = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: Other white space makes that cut uncertain; such a text is encoded whole.
OTHER_SPACE = re.compile(r"[^\S \n]")
#: A plain piece: at most one blank, letters, then ASCII signs. Both tokenizers cut before
#: the signs and nowhere else in it, so its parts can go to the model of the tokenizer as they are.
PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)\Z")
#: Plain pieces on which the two ways are compared before the short one is used.
PROBES = ("word", "Word", "État", "straße,", "Ñandú###", "end.", "naïve?!", "<|", "e_", " word", " Øre;", " &&&", " a|")
#: Stands between pieces that are encoded in one call; a special token, so pieces do not touch.
BETWEEN = "<|endoftext|>"


class Encoder:
    """Encodes texts piece by piece and remembers pieces, up to a fixed number.

    The strings of special tokens in a text are ordinary text. Results equal
    those of encoding each whole text, as the tests check.
    """

    def __init__(self, path: str, keep: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        self.between = self.plain.token_to_id(BETWEEN)
        self.model = self.plain.model
        #: Whether blanks before a word leave its ids as they are; then words are the pieces.
        self.drops_blanks = len({self._whole(x) for x in ("a", " a", "\na", " \n a")}) == 1
        self.spelled = self._spelling()
        self.known: dict[str, bytes] = {}
        self.keep = keep
        #: Whether plain pieces may skip the steps before the model.
        self.direct = all(self._plain(p.strip() if self.drops_blanks else p) == self._whole(p) for p in PROBES)
        self.known = {}

    def _spelling(self) -> dict[int, str]:
        """How the model spells each Latin-1 character: its bytes as letters, small where case does not matter."""
        from tokenizers.pre_tokenizers import ByteLevel

        bytewise = ByteLevel(add_prefix_space=False, use_regex=False)
        small = self._whole("A") == self._whole("a")
        return {c: bytewise.pre_tokenize_str(chr(c).lower() if small else chr(c))[0][0] for c in range(256)}

    def _whole(self, text: str) -> bytes:
        return np.array(self.plain.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece, many in one call."""
        if any("<|" in p for p in pieces):
            return [self._whole(p) for p in pieces]
        self.plain.encode_special_tokens = False
        ids = np.array(self.plain.encode_batch_fast([BETWEEN.join(pieces)], add_special_tokens=False)[0].ids, dtype="<u4")
        self.plain.encode_special_tokens = True
        ends = [*np.flatnonzero(ids == self.between).tolist(), len(ids)]
        raw, out, at = ids.tobytes(), [], 0
        for end in ends:
            out.append(raw[4 * at : 4 * end])
            at = end + 1
        return out

    def _plain(self, piece: str) -> bytes | None:
        """Ids of a plain piece from the model itself, None for any other."""
        form = PLAIN.match(piece)
        if not form or not piece:
            return None
        body, signs = form.groups()
        parts = (body, signs) if signs and body.strip() else (piece,)
        known = self.known
        for part in parts:
            if part not in known:
                ids = [t.id for t in self.model.tokenize(part.translate(self.spelled))]
                known[part] = struct.pack(f"<{len(ids)}I", *ids)
        return known[body] + known[signs] if len(parts) == 2 else known[piece]

    def plain_ids(self, piece: str) -> bytes | None:
        """Ids of a plain piece if such pieces may go to the model as they are, else None."""
        return self._plain(piece) if self.direct else None

    def _learn(self, pieces: list[str]) -> None:
        """Add pieces to the known ones: plain ones by the model, the others many in one call."""
        known, others = self.known, []
        for piece in pieces:
            if self.direct:
                if piece[0] == "\n" and piece[1:2] not in ("", " ", "\n"):  # a line end before a word stands alone
                    if "\n" not in known:
                        known["\n"] = self._whole("\n")
                    rest = self._plain(piece[1:])
                    ids = None if rest is None else known["\n"] + rest
                else:
                    ids = self._plain(piece)
                if ids is not None:
                    known[piece] = ids
                    continue
            others.append(piece)
        for at in range(0, len(others), 64):
            part = others[at : at + 64]
            known.update(zip(part, self._pieces(part), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null is empty."""
        if len(self.known) > self.keep:
            self.known = {}
        known = self.known
        cut: list[list[str] | None] = []
        new: set[str] = set()
        for text in texts:
            if not text:
                cut.append([])
                continue
            words = text.split()
            if " ".join(words) == text.replace("\n", " ") and "\0" not in text:  # single blanks only: the usual text
                pieces = words if self.drops_blanks else text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
            elif OTHER_SPACE.search(text):
                cut.append(None)
                continue
            else:
                pieces = words if self.drops_blanks else PIECES.findall(text)
            cut.append(pieces)
            new.update(set(pieces).difference(known))
        if new:
            self._learn(list(new))
        return [self._whole(t) if pieces is None else b"".join(map(known.__getitem__, pieces)) for t, pieces in zip(texts, cut, strict=True)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, keep: int = 400_000) -> Encoder:
    """The encoder of this Python worker, which later tasks use again."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, keep)
    return _ENCODERS[path]
