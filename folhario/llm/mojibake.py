"""Text that was decoded with the wrong character encoding, found and put right.

Round trips: a stretch of text is encoded again under a legacy encoding it may have been
read with, and strictly decoded under the encoding it was written in. UTF-8 read as a
single-byte encoding gives itself away by its byte structure: a run of non-ASCII
characters that turns into valid UTF-8, shorter and less garbled, is repaired, again and
again for nested layers until nothing changes.
One single-byte encoding read as another has no such structure; there each word is
weighed by a garbling cost before and after, and the encoding is accepted for a line
when the cost of the line's words drops.

Defined cases: null, empty, blank and ASCII texts are clean and come back as they are;
replacement characters make a text garbled but can't be restored; repeated rows each
get their own result; extra columns pass through, a clashing `repaired` or `garbled`
column is replaced. Texts of any length are read to their end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folhario.runtime import without

#: Encodings that UTF-8 bytes may have been read with.
READ_AS = ("cp1252", "latin-1", "mac_roman", "cp850", "cp1251", "cp437")
#: (read as, written in) for single-byte text read as another single-byte encoding.
SWAPPED = (("mac_roman", "cp1252"), ("cp850", "cp1252"), ("cp437", "cp1252"), ("cp1251", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp850"))


@lru_cache(maxsize=16)
def _table(name: str) -> tuple[dict[str, int], dict[int, str]]:
    """Character to byte and back for a single-byte encoding; bytes without a character stand for themselves."""
    to: dict[str, int] = {}
    for b in range(256):
        try:
            to.setdefault(bytes([b]).decode(name), b)
        except UnicodeDecodeError:
            to.setdefault(chr(b), b)
    if name == "mac_roman":
        to.setdefault("¤", 0xDB)
    return to, {b: c for c, b in to.items()}


@lru_cache(maxsize=16)
def _runs(name: str) -> re.Pattern:
    """What UTF-8 sequences of two to four bytes look like after being read as `name`."""
    back = _table(name)[1]
    cls = lambda lo, hi: "[" + "".join(re.escape(back[b]) for b in range(lo, hi + 1)) + "]"
    tail = cls(0x80, 0xBF)
    return re.compile(f"(?:{cls(0xC2, 0xDF)}{tail}|{cls(0xE0, 0xEF)}{tail}{{2}}|{cls(0xF0, 0xF4)}{tail}{{3}})+")


@lru_cache(maxsize=1)
def _any_run() -> re.Pattern:
    """The first two characters of a run under any of the encodings: most texts have none and are done with it."""
    parts = []
    for name in READ_AS:
        back = _table(name)[1]
        cls = lambda lo, hi, back=back: "[" + "".join(re.escape(back[b]) for b in range(lo, hi + 1)) + "]"
        parts.append(cls(0xC2, 0xF4) + cls(0x80, 0xBF))
    return re.compile("|".join(parts))


def _plausible(text: str) -> bool:
    """Whether a decoded stretch may stand in a text: no controls, no unassigned or private characters."""
    return all(c.isprintable() or c in "\xad​‍‌\xa0﻿ " or "\x80" <= c <= "\x9f" for c in text)


def _utf8_pass(text: str) -> str:
    """One layer of UTF-8 undone, under the encoding whose runs cover most of the text."""
    best, most = text, 0
    if not _any_run().search(text):
        return text
    for name in READ_AS:
        to = _table(name)[0]
        gone = 0

        def fix(m: re.Match, to=to) -> str:
            nonlocal gone
            run = m.group()
            try:
                new = bytes(to[c] for c in run).decode("utf-8")
            except UnicodeDecodeError:
                return run
            # the cost of a run is its characters' and one for each that a sequence has too many
            if len(new) >= len(run) or not _plausible(new) or word_cost(new) >= word_cost(run) + len(run) - len(new):
                return run
            gone += len(run)
            return new

        new = _runs(name).sub(fix, text)
        if gone > most:
            best, most = new, gone
    return best


LOWER = set("áàâãéêíóôõúçñüïöèäëìòùîûåøæœ")
UPPER = set("ÁÀÂÃÉÊÍÓÔÕÚÇÑÜÖÅŒ")
HOME = set("áàâãéêíóôõúçñ")
AFTER_NUMBER = set("ºª°²³½¼¾¹")
WORD = re.compile(r"\S+")


@lru_cache(maxsize=100_000)
def word_cost(word: str) -> float:
    """How garbled a word looks: characters that can't stand where they do."""
    cost = 0.0
    n = len(word)
    letters = [c for c in word if c.isalpha()]
    upper = sum(c.isupper() for c in letters) > 0.6 * len(letters) if letters else False
    for i, c in enumerate(word):
        if c < "\x80":
            continue
        before = word[i - 1] if i else " "
        after = word[i + 1] if i + 1 < n else " "
        if c == "�" or "\x80" <= c <= "\x9f":
            cost += 3
        elif c in LOWER:
            if upper and (before.isupper() or after.isupper()):
                cost += 1.5
            elif c not in HOME:
                cost += 0.5
        elif c in UPPER:
            if before.isalpha() and before.islower() or (after.isalpha() and before.isalpha() and after.islower()):
                cost += 2
            elif after.isalpha() and after.isupper() or before.isalpha():
                cost += 0
            elif after.isalpha():
                cost += 0.2
            else:
                cost += 0.8
        elif c in "µ±":
            cost += 0.1 if not before.isalpha() else 1.6
        elif c in AFTER_NUMBER:
            cost += 0.1 if before.isdigit() or before in "mnN§.º" or before == " " else 2 if after.isalpha() or before.isalpha() else 0.3
        elif "Ͱ" <= c <= "῿" or c >= "⺀":
            cost += 0.4
        elif c.isalpha():
            cost += 2
        elif before.isalpha() or after.isalpha():
            cost += 1.6 if before.isalpha() and c not in "”’»)…—–\xad​\xa0" or after.isalpha() and c not in "“‘«(—–§•\xad​\xa0" else 0.2
        else:
            cost += 0.6
    return cost


def _swap(text: str, read: str, written: str) -> str | None:
    to, back = _table(read)[0], _table(written)[1]
    out = []
    for c in text:
        if c < "\x80":
            out.append(c)
        elif c in to and to[c] >= 0x80 and not "\x80" <= (new := back[to[c]]) <= "\x9f":
            out.append(new)
        else:
            return None
    return "".join(out)


def _gains(line: str) -> dict[tuple[str, str], tuple[float, dict[str, str]]]:
    """For each pair of encodings how much cheaper the line's words get, and the words it changes."""
    words = {w for w in line.split() if not w.isascii()}
    base = {w: word_cost(w) for w in words}
    if not base or max(base.values()) < 1.5:
        return {}
    out = {}
    for pair in SWAPPED:
        gain, fix = 0.0, {}
        for w, cost in base.items():
            new = _swap(w, *pair)
            if new is None or new == w:
                continue
            drop = cost - word_cost(new)
            if drop > 0 or cost >= 0.6 and drop >= 0:
                fix[w] = new
                gain += drop
        if gain >= 1.2:
            out[pair] = gain, fix
    return out


def _single_byte_pass(text: str) -> str:
    """Lines read again from another single-byte encoding where that makes their words cheaper.

    A line takes the pair that helps it most; where pairs are close, the one that helps
    most in the whole text.
    """
    lines = text.split("\n")
    found = {i: g for i, x in enumerate(lines) if not x.isascii() and (g := _gains(x))}
    if not found:
        return text
    total: dict[tuple[str, str], float] = {}
    for gains in found.values():
        for pair, (gain, _) in gains.items():
            total[pair] = total.get(pair, 0.0) + gain
    for i, gains in found.items():
        top = max(g for g, _ in gains.values())
        pair = max((p for p, (g, _) in gains.items() if g >= 0.7 * top), key=lambda p: (total[p], -SWAPPED.index(p)))
        fix = gains[pair][1]
        lines[i] = WORD.sub(lambda m, fix=fix: fix.get(m.group(), m.group()), lines[i])
    return "\n".join(lines)


def repair(text: str | None) -> tuple[str | None, bool]:
    """(text put right as far as it can be known, whether any part of it was garbled)."""
    if not text or text.isascii():
        return text, False
    now, found = text, "�" in text
    while (new := _utf8_pass(now)) != now:  # every layer undone leaves a shorter text
        now, found = new, True
    done = _single_byte_pass(now)
    return done, found or done != now


def repair_corpus(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` with `repaired` (string) and `garbled` (boolean).

    ASCII texts never reach Python: they are told apart inside the scan's stage.
    """
    kept = without(df, "repaired", "garbled")
    schema = kept.schema.add("repaired", "string").add("garbled", "boolean")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = [repair(t) for t in batch[text]]
            yield batch.assign(repaired=[p[0] for p in pairs], garbled=[p[1] for p in pairs])

    odd = F.coalesce(F.col(text).rlike(r"[^\x00-\x7f]"), F.lit(False))
    plain = kept.where(~odd).withColumn("repaired", F.col(text)).withColumn("garbled", F.lit(False))
    return kept.where(odd).mapInPandas(run, schema).unionByName(plain)


def garbled_rows(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The keys of the garbled rows."""
    return repair_corpus(df.select(key, text).where(F.col(text).rlike(r"[^\x00-\x7f]")), text).where("garbled").select(key)
