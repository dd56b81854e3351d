"""Variant spellings of one person or organisation, linked by a trie join.

Names are reduced to different spellings first, with their counts, so a name that a
third of all rows bear is one row. Spellings with the same parts are one key. Keys are
sharded by their parts; in a shard the tokens stand in a trie that a Levenshtein
automaton walks to list each token's neighbours within a bounded distance, and names
are compared on the tokens thus put right: in order, turned round, with initials,
nicknames and dropped parts. A short form that would fit two different people of a
shard is linked to neither. Links go to one head a cluster, not to every member, and
the clusters of all shards are joined as connected components.

Sharding. A name stands in a shard for each of its surnames (with the first letter of
the given name), and in shards made of pieces of two surnames for those that are
misspelled. A shard larger than `largest` is compared by the same rules over many tasks
(`hot_links`), with the same links: none is dropped for its size.

Defined cases: null, blank and stand-in values are no names; a spelling is taken exactly
as stored, blanks included; repeated rows count once; a lone spelling gives no pair;
names of one word are linked to nothing but themselves; extra columns and an empty
table are no matter.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folhario.functions.values import filled
from folhario.llm.names import COMMON_GIVEN, NICK, agree, allowed, given_match, is_initial, parse, skeleton, spelled
from folhario.operators.graph import components
from folhario.runtime import bounded_rows, broadcast_if_small, cut

EDITS = 3
KEY_SCHEMA = "name string, n long, key string, kind string, tokens array<string>, suffix string, org string, acronym string"
SHARD_SCHEMA = "shard string, key string, kind string, tokens array<string>, suffix string, n long, forms long"
PLACE = ("shard", "last", "suffix")


class Trie:
    """Words by their letters; `near` walks it with the rows of a Levenshtein automaton.

    Below a letter that only one word goes through, the rest of that word stands as it is.
    """

    __slots__ = ("next", "rest", "word")

    def __init__(self, word: str | None = None, rest: str = ""):
        self.next: dict[str, Trie] = {}
        self.word, self.rest = word, rest

    def add(self, word: str) -> None:
        node, i = self, 0
        while True:
            if node.rest:  # the one word here goes a letter down, to make room
                old, rest = node.word, node.rest
                if rest == word[i:]:
                    return
                node.word, node.rest = None, ""
                node.next[rest[0]] = Trie(old, rest[1:])
            if i == len(word):
                node.word = word
                return
            below = node.next.get(word[i])
            if below is None:
                node.next[word[i]] = Trie(word, word[i + 1 :])
                return
            node, i = below, i + 1

    def near(self, word: str, most: int) -> list[str]:
        """Every word of the trie within `most` edits (a swap of neighbours is one).

        The automaton's states are bits: bit i of the d-th number says that the path so
        far may be the word's first i letters with d edits. A step is a few operations
        on whole numbers, and a branch is left once no state is alive.
        """
        mask: dict[str, int] = {}
        for i, c in enumerate(word):
            mask[c] = mask.get(c, 0) | 1 << i
        get = mask.get
        done = 1 << len(word)
        full = 2 * done - 1
        out: list[str] = []
        # a state: node, the mask of the letter before, this row, the row before it; rows past the first letter only
        stack = [(self, 0, tuple((2 << d) - 1 & full for d in range(most + 1)), (0,) * (most + 1))]
        while stack:
            node, before, last, older = stack.pop()
            if node.rest:
                if most == 1:  # the common bounds, without a loop over rows
                    (l0, l1), (o0, _) = last, older
                    for c in node.rest:
                        m = get(c, 0)
                        r0 = (l0 & m) << 1
                        r1 = ((l1 & m) << 1 | l0 << 1 | l0 | r0 << 1 | (o0 & m & before >> 1) << 2) & full
                        if not r1:
                            break
                        o0, l0, l1, before = l0, r0, r1, m
                    else:
                        if l1 & done:
                            out.append(node.word)
                elif most == 2:
                    (l0, l1, l2), (o0, o1, _) = last, older
                    for c in node.rest:
                        m = get(c, 0)
                        swap = m & before >> 1
                        r0 = (l0 & m) << 1
                        r1 = ((l1 & m) << 1 | l0 << 1 | l0 | r0 << 1 | (o0 & swap) << 2) & full
                        r2 = ((l2 & m) << 1 | l1 << 1 | l1 | r1 << 1 | (o1 & swap) << 2) & full
                        if not r2:
                            break
                        o0, o1, l0, l1, l2, before = l0, l1, r0, r1, r2, m
                    else:
                        if l2 & done:
                            out.append(node.word)
                else:
                    for c in node.rest:
                        m = get(c, 0)
                        last, older, before = self._row(last, older, m, m & before >> 1, full), last, m
                        if not last[-1]:
                            break
                    else:
                        if last[-1] & done:
                            out.append(node.word)
                continue
            if node.word is not None and last[-1] & done:
                out.append(node.word)
            for c, below in node.next.items():
                m = get(c, 0)
                row = self._row(last, older, m, m & before >> 1, full)
                if row[-1]:
                    stack.append((below, m, row, last))
        return out

    @staticmethod
    def _row(last: tuple[int, ...], older: tuple[int, ...], m: int, swap: int, full: int) -> tuple[int, ...]:
        """The automaton's next row: same letter; another letter; a letter more; a letter less; two letters swapped."""
        r = (last[0] & m) << 1
        row = [r]
        for d in range(1, len(last)):
            r = ((last[d] & m) << 1 | last[d - 1] << 1 | last[d - 1] | r << 1 | (older[d - 1] & swap) << 2) & full
            row.append(r)
        return tuple(row)


class Vocabulary:
    """Tokens in two tries, as written and (those that differ from that) plainly spelled, for neighbours by either."""

    def __init__(self, tokens=()):
        self.written, self.odd = Trie(), Trie()
        self.by_plain: dict[str, list[str]] = defaultdict(list)
        for t in tokens:
            self.add(t)

    def add(self, token: str) -> None:
        s = skeleton(token)
        if s != token:
            if s not in self.by_plain:
                self.odd.add(s)
            self.by_plain[s].append(token)
        self.written.add(token)

    def near(self, token: str, most: int) -> set[str]:
        out = set(self.written.near(token, most))
        s = skeleton(token)
        if s != token:
            out.update(t for t in self.written.near(s, most) if skeleton(t) == t)
        if self.by_plain:
            for plain in self.odd.near(s, most):
                out.update(self.by_plain[plain])
        return out


def token_heads(weights: dict[str, int]) -> dict[str, str]:
    """For each token the one it is taken for: the nearest, then most frequent, head among its neighbours.

    Tokens are taken by falling weight, and only heads are joined, so a chain of small
    differences can't run from one word to another.
    """
    words = Vocabulary()  # of the heads alone
    heads: dict[str, str] = {}
    for t in sorted(weights, key=lambda t: (-weights[t], t)):
        fits = [(d, -weights[u], u) for u in words.near(t, allowed(t, t)) if (d := spelled(t, u)) is not None]
        heads[t] = min(fits)[2] if fits else t
        if not fits:
            words.add(t)
    return heads


def is_whole(tokens: tuple[str, ...], given: frozenset[str]) -> bool:
    """Whether a name is a full one: a given name and two surnames, all written out."""
    return len(tokens) >= 3 and not is_initial(tokens[0]) and not is_initial(tokens[-2]) and tokens[-2] not in given


def same_full(tokens, heads, given: frozenset[str]) -> list[str]:
    """Of the full names `heads` (key, tokens) those that are of one person with a full name."""
    return [k for k, t in heads if (a := agree(tokens, t, given)) and a.full >= 3 and a.edits <= EDITS]


def fitting(tokens, heads, given: frozenset[str]) -> tuple[list[str], list[str]]:
    """Of the full names `heads` those that a short form fits, and those it fits strongly."""
    fits = [(k, a) for k, t in heads if (a := agree(tokens, t, given)) and a.edits <= EDITS - 1 and a.full + (a.initials > 0) >= 2]
    return [k for k, _ in fits], [k for k, a in fits if a.full >= 2 and len(tokens) >= 3]


def same_short(tokens, lone, given: frozenset[str]) -> str | None:
    """The first of the short forms `lone` that is the same as a short form."""
    return next((k for k, t in lone if (a := agree(tokens, t, given)) and a.full >= 2 and a.edits <= 1), None)


def link_people(rows: list[tuple[str, tuple[str, ...], str, int]], given: frozenset[str]) -> list[tuple[str, str]]:
    """Links (key, head) among the names of one shard; rows are (key, tokens, suffix, count)."""
    weights: dict[str, int] = defaultdict(int)
    for _, tokens, _, n in rows:
        for t in tokens[1:]:
            if not is_initial(t):
                weights[t] += n
    heads = token_heads(weights)
    full, short = [], []
    for row in sorted(rows, key=lambda r: (r[1][0] not in given, -r[3], r[0])):
        (full if is_whole(row[1], given) else short).append(row)
    out: list[tuple[str, str]] = []
    exact: dict[tuple[str, str, str], list] = defaultdict(list)
    by_last: dict[tuple[str, str], list] = defaultdict(list)
    for key, tokens, suffix, _n in full:
        place = (heads.get(tokens[-1], tokens[-1]), heads[tokens[-2]], suffix)
        same = same_full(tokens, exact[place], given)
        out += [(key, k) for k in same]
        if not same:
            exact[place].append((key, tokens))
            by_last[place[0], suffix].append((key, tokens))
    lone: dict[tuple[str, str], list] = defaultdict(list)
    for key, tokens, suffix, _n in short:
        last = (heads.get(tokens[-1], tokens[-1]), suffix)
        fits, strong = fitting(tokens, by_last[last], given)
        if len(fits) == 1 or len(strong) == 1:
            out.append((key, strong[0] if strong else fits[0]))
        elif not fits and len(tokens) >= 2:
            k = same_short(tokens, lone[last], given)
            if k is None:
                lone[last].append((key, tokens))
            else:
                out.append((key, k))
    return out


def word_heads(weights: dict[str, int]) -> dict[str, str]:
    """For each telling word of organisations the one it is taken for.

    Few letters tell organisations apart, so two telling words are one only if they are
    an edit apart and one of them looks like a slip: letters swapped, doubled or left
    out, or a spelling that `weights` (the ways names with it are written) shows to be rare.
    """
    words = Vocabulary()  # of the heads alone
    heads: dict[str, str] = {}
    for t in sorted(weights, key=lambda t: (-weights[t], t)):
        fits = []
        for u in words.near(t, 1 if len(t) >= 5 else 0):
            slip = len(u) != len(t) or sorted(u) == sorted(t) or skeleton(u) == skeleton(t) or weights[t] <= 2 and weights[u] > 2 * weights[t]
            if slip:
                fits.append((spelled(t, u) or 0, -weights[u], u))
        heads[t] = min(fits)[2] if fits else t
        if not fits:
            words.add(t)
    return heads


def link_organisations(rows: list[tuple[str, tuple[str, ...], str, int]], forms: dict[str, int]) -> list[tuple[str, str]]:
    """Links among organisations of one shard: one kind, and the same telling words in any order."""
    weights: dict[str, int] = defaultdict(int)
    for key, tokens, _, _n in rows:
        for t in tokens:
            weights[t] += forms[key]
    heads = word_heads(weights)
    first: dict[tuple[str, ...], str] = {}
    out = []
    for key, tokens, kind, _n in sorted(rows, key=lambda r: (-forms[r[0]], -r[3], r[0])):
        place = (kind, *sorted({heads[t] for t in tokens}))
        if place in first:
            out.append((key, first[place]))
        else:
            first[place] = key
    return out


class Turner:
    """Puts names in order that are written surname first without a comma; holds the given names' spellings and tries."""

    def __init__(self, given: frozenset[str]):
        self.given = given
        self.plain = {skeleton(g) for g in given}
        self.words = Vocabulary(given)
        self.met: dict[str, bool] = {}

    def near(self, token: str) -> bool:
        """Whether a token may be a given name, misspelled."""
        if token not in self.met:
            if len(self.met) > 200_000:
                self.met.clear()
            self.met[token] = any(spelled(token, g) is not None for g in self.words.near(token, allowed(token, token)))
        return self.met[token]

    def __call__(self, tokens: list[str]) -> list[str]:
        first = tokens[0] if tokens else ""
        if len(tokens) < 2 or first in self.given or first in NICK or is_initial(first):
            return tokens
        if tokens[-1] in self.given:
            return tokens[::-1]
        if len(tokens) >= 3 and tokens[1] in self.given and skeleton(first) not in self.plain:
            return tokens if self.near(first) else tokens[1:] + tokens[:1]
        return tokens


def keyed(names: DataFrame) -> DataFrame:
    """`names` (name, n) parsed, with the key of equal parts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, n in zip(batch["name"], batch["n"]):
                p = parse(name)
                if p.kind:
                    key = {"person": f"p|{' '.join(p.tokens)}|{p.suffix}", "org": f"o|{p.org}|{' '.join(p.tokens)}", "acronym": f"a|{p.acronym}"}[p.kind]
                    rows.append((name, n, key, p.kind, list(p.tokens), p.suffix, p.org, p.acronym))
            yield pd.DataFrame(rows, columns=["name", "n", "key", "kind", "tokens", "suffix", "org", "acronym"])

    return names.mapInPandas(run, KEY_SCHEMA)


def given_names(keys: DataFrame, least: int = 3, largest: int = 1_000_000) -> frozenset[str]:
    """Given names: common ones, and those learnt from all names: first tokens that stand before several different surnames.

    A token near a far more frequent one is a misspelling of it. The list that reaches
    the driver has a checked bound and holds single words, never names.
    """
    first = keys.where("kind = 'person' and size(tokens) > 1").select(F.col("tokens")[0].alias("t"), F.element_at("tokens", -1).alias("l"))
    counted = first.where("length(t) > 2").groupBy("t").agg(F.approx_count_distinct("l", 0.02).alias("n")).where(F.col("n") >= least)
    rows = sorted(((r.n, r.t) for r in bounded_rows(counted, largest)), reverse=True)
    kept: dict[str, int] = {}
    words = Vocabulary()
    for n, t in rows:
        if t in NICK or any(kept[g] >= 6 * n and spelled(t, g) is not None for g in words.near(t, allowed(t, t))):
            continue
        kept[t] = n
        words.add(t)
    return frozenset(kept) | COMMON_GIVEN


def _shards(tokens: list[str], kind: str, org: str, given: frozenset[str]) -> list[str]:
    """Shards in which a name is compared."""
    if kind == "org":
        return [x for t in tokens or [""] for s in [skeleton(t)] for x in (f"O|{org}|{s[:2]}", f"Z|{org}|{s[-3:]}")]
    if len(tokens) < 2:
        return []
    first, inner = tokens[0], [skeleton(t) for t in tokens[1:] if not is_initial(t)]
    if not inner:
        return []
    letters = sorted({first[0], *(x[0] for x in NICK.get(first, ()))})
    names = [skeleton(t) for t in tokens[1:] if not is_initial(t) and t not in given] or inner[-1:]
    out = [f"T|{t}|{x}" for t in names for x in letters]
    last = inner[-1]
    out += [f"Q|{skeleton(first)}|{last[:4]}", f"R|{skeleton(first)}|{last[-5:]}"]
    if len(tokens) >= 3 and len(inner) >= 2:
        m = inner[-2]
        out += [f"P|{m[:3]}|{last[:3]}", f"S|{m[-4:]}|{last[-4:]}", f"M|{m[:3]}|{last[-4:]}", f"N|{m[-4:]}|{last[:3]}"]
    return out


class Firsts:
    """Names by their first token; `near` lists those whose first token may agree, in the order they came."""

    def __init__(self, given: frozenset[str]):
        self.given, self.size = given, 0
        self.by: dict[str, list] = {}
        self.met: dict[str, list] = {}

    def add(self, key: str, tokens: tuple[str, ...]) -> None:
        first = tokens[0]
        if first not in self.by:
            self.by[first] = []
            for f, lists in self.met.items():
                if given_match(f, first, self.given) is not None:
                    lists.append(self.by[first])
        self.by[first].append((self.size, key, tokens))
        self.size += 1

    def near(self, tokens: tuple[str, ...]) -> Iterator[tuple[str, tuple[str, ...]]]:
        first = tokens[0]
        if first not in self.met:
            self.met[first] = [names for f, names in self.by.items() if given_match(first, f, self.given) is not None]
        return ((k, t) for _, k, t in sorted(chain.from_iterable(self.met[first])))


def _streamed(df: DataFrame, by: Sequence[str], order: Sequence, schema: str, step) -> DataFrame:
    """`df` grouped by `by` and in `order`, row by row through a function that `step()` makes for each group."""
    columns, out = df.columns, [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, take = None, None
        for batch in batches:
            done: list[tuple] = []
            for group, *row in zip(zip(*(batch[c] for c in by)), *(batch[c] for c in columns)):
                if group != now:
                    now, take = group, step()
                done += take(dict(zip(columns, row)))
            yield pd.DataFrame(done, columns=out)

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, schema)


def hot_links(rows: DataFrame, held, largest: int) -> DataFrame:
    """(a, b): the links that `link_people` and `link_organisations` give, for shards too large for one task.

    The words of a shard are taken for their heads first, from all of its names. Full
    names then meet those with the heads of both surnames; short forms meet all full
    names with the head of the last one, in blocks of about `largest`, and what they fit
    is counted over all blocks before it is decided; short forms that fit nobody meet
    each other. Each step goes through sorted rows and keeps only the heads of a group.
    """

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            people, tokens = batch["kind"] == "person", [tuple(t) for t in batch["tokens"]]
            batch["whole"] = [bool(p) and is_whole(t, held.value) for p, t in zip(people, tokens)]
            batch["strange"] = [bool(p) and t[0] not in held.value for p, t in zip(people, tokens)]
            batch["weighed"] = [[x for x in t[1:] if not is_initial(x)] if p else list(t) for p, t in zip(people, tokens)]
            yield batch

    rows = cut(rows.mapInPandas(mark, f"{SHARD_SCHEMA}, whole boolean, strange boolean, weighed array<string>"))
    person = F.col("kind") == "person"
    vocabulary = rows.select("shard", "kind", F.explode("weighed").alias("token"), F.when(person, F.col("n")).otherwise(F.col("forms")).alias("w")).groupBy("shard", "kind", "token").agg(F.sum("w").alias("w"))

    def to_heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, kind, weights = None, "", {}

        def flush() -> pd.DataFrame:
            heads = token_heads(weights) if kind == "person" else word_heads(weights)
            return pd.DataFrame([(now, t, h) for t, h in heads.items()], columns=["shard", "token", "head"])

        for batch in batches:
            for shard, k, token, w in zip(batch["shard"], batch["kind"], batch["token"], batch["w"]):
                if shard != now:
                    yield flush()
                    now, kind, weights = shard, k, {}
                weights[token] = w
        yield flush()

    heads = vocabulary.repartition("shard").sortWithinPartitions("shard").mapInPandas(to_heads, "shard string, token string, head string")
    wanted = F.when(person, F.slice("tokens", -2, 2)).otherwise(F.col("tokens"))
    taken = rows.select("shard", "key", F.posexplode_outer(wanted).alias("pos", "token")).join(heads, ["shard", "token"], "left")
    taken = taken.groupBy("shard", "key").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("head", "token").alias("head")))).alias("taken"))
    placed = cut(rows.join(taken.select("shard", "key", F.col("taken.head").alias("taken")), ["shard", "key"]))

    bodies = placed.where(~person).withColumn("taken", F.array_sort(F.array_distinct(F.array_compact("taken"))))
    chief = bodies.groupBy("shard", "suffix", "taken").agg(F.min(F.struct(-F.col("forms"), -F.col("n"), "key"))["key"].alias("b"))
    out = [bodies.join(chief, ["shard", "suffix", "taken"]).where("key <> b").select(F.col("key").alias("a"), "b")]

    people = placed.where(person).select("shard", F.col("taken")[1].alias("last"), F.col("taken")[0].alias("before"), "suffix", "key", "tokens", "whole", "strange", "n")
    order = ["strange", F.desc("n"), "key"]

    def full_names():
        known = Firsts(held.value)

        def take(r: dict) -> list[tuple]:
            tokens = tuple(r["tokens"])
            same = same_full(tokens, known.near(tokens), held.value)
            if not same:
                known.add(r["key"], tokens)
            return [(r["shard"], r["last"], r["suffix"], r["key"], list(tokens), k) for k in same or [None]]

        return take

    full = cut(_streamed(people.where("whole"), ["shard", "last", "before", "suffix"], order, "shard string, last string, suffix string, key string, tokens array<string>, head string", full_names))
    out.append(full.where("head is not null").select(F.col("key").alias("a"), F.col("head").alias("b")))

    full = full.where("head is null").drop("head")
    blocks = full.groupBy(*PLACE).agg(F.ceil(F.count("*") / largest).cast("int").alias("blocks"))
    block = full.join(blocks, [*PLACE]).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).drop("blocks")
    short = people.where("not whole").select(*PLACE, "key", "tokens").join(blocks, [*PLACE], "left")
    short = short.withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")

    def short_forms():
        known = Firsts(held.value)

        def take(r: dict) -> list[tuple]:
            tokens = tuple(r["tokens"])
            if not r["short"]:
                known.add(r["key"], tokens)
                return []
            fits, strong = fitting(tokens, known.near(tokens), held.value)
            return [(r["shard"], r["key"], len(fits), fits[0] if fits else None, len(strong), strong[0] if strong else None)]

        return take

    met = block.withColumn("short", F.lit(False)).unionByName(short.withColumn("short", F.lit(True)))
    met = _streamed(met, [*PLACE, "block"], ["short"], "shard string, key string, fits long, fit string, strong long, best string", short_forms)
    met = cut(met.groupBy("shard", "key").agg(F.sum("fits").alias("fits"), F.min("fit").alias("fit"), F.sum("strong").alias("strong"), F.min("best").alias("best")))
    out.append(met.where("fits = 1 or strong = 1").select(F.col("key").alias("a"), F.coalesce("best", "fit").alias("b")))

    def lone_forms():
        known = Firsts(held.value)

        def take(r: dict) -> list[tuple]:
            tokens = tuple(r["tokens"])
            k = same_short(tokens, known.near(tokens), held.value)
            if k is None:
                known.add(r["key"], tokens)
                return []
            return [(r["key"], k)]

        return take

    lone = people.where("not whole").join(met.where("fits = 0").select("shard", "key"), ["shard", "key"], "left_semi")
    out.append(_streamed(lone, PLACE, order, "a string, b string", lone_forms))
    return reduce(DataFrame.unionByName, out)


def links(keys: DataFrame, given: frozenset[str], largest: int = 5000) -> DataFrame:
    """(a, b): each key and the head of its cluster, for every shard."""
    held = keys.sparkSession.sparkContext.broadcast(given)

    def spread_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turned = Turner(held.value)
        for batch in batches:
            rows = []
            for key, kind, tokens, suffix, org, n, forms in zip(batch["key"], batch["kind"], batch["tokens"], batch["suffix"], batch["org"], batch["n"], batch["forms"]):
                tokens = list(tokens)
                if kind == "person":
                    tokens = turned(tokens)
                for shard in dict.fromkeys(_shards(tokens, kind, org, held.value)):
                    rows.append((shard, key, kind, tokens, org if kind == "org" else suffix, n, forms))
            yield pd.DataFrame(rows, columns=["shard", "key", "kind", "tokens", "suffix", "n", "forms"])

    sharded = keys.where("kind <> 'acronym'").select("key", "kind", "tokens", "suffix", "org", "n", "forms").mapInPandas(spread_out, SHARD_SCHEMA)
    hot = cut(sharded.groupBy("shard").count().where(F.col("count") > largest).select("shard"))
    some_hot = not hot.isEmpty()
    if some_hot:
        hot = broadcast_if_small(hot, 10_000)
    placed = sharded.join(hot, "shard", "left_anti") if some_hot else sharded

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rows, done = None, [], []

        def flush() -> None:
            if len(rows) > 1:
                people = [r[1:2] + r[3:6] for r in rows if r[2] == "person"]
                bodies = [r[1:2] + r[3:6] for r in rows if r[2] == "org"]
                done.extend(link_people(people, held.value) if len(people) > 1 else [])
                done.extend(link_organisations(bodies, {r[1]: r[6] for r in rows}) if len(bodies) > 1 else [])

        for batch in batches:
            for shard, key, kind, tokens, suffix, n, forms in zip(*(batch[c] for c in ("shard", "key", "kind", "tokens", "suffix", "n", "forms"))):
                if shard != now:
                    flush()
                    now, rows = shard, []
                rows.append((shard, key, kind, tuple(tokens), suffix, n, forms))
            yield pd.DataFrame(done, columns=["a", "b"])
            done = []
        flush()
        yield pd.DataFrame(done, columns=["a", "b"])

    grouped = placed.select("shard", "key", "kind", "tokens", "suffix", "n", "forms").repartition("shard").sortWithinPartitions("shard")
    found = grouped.mapInPandas(compare, "a string, b string")
    if some_hot:
        found = found.unionByName(hot_links(sharded.join(hot, "shard", "left_semi"), held, largest))
    return found.distinct()


def entities(df: DataFrame, columns: Sequence[str], largest: int = 5000) -> DataFrame:
    """(name, entity) of every different spelling in `columns`."""
    stacked = reduce(DataFrame.unionByName, [df.select(F.col(c).cast("string").alias("name")) for c in columns])
    names = stacked.where(filled(F.col("name"))).groupBy("name").agg(F.count("*").alias("n"))
    spellings = keyed(names)

    spellings = cut(spellings)
    keys = spellings.groupBy("key").agg(F.first("kind").alias("kind"), F.first("tokens").alias("tokens"), F.first("suffix").alias("suffix"), F.first("org").alias("org"), F.sum("n").alias("n"), F.count("*").alias("forms"))
    found = links(keys, given_names(keys), largest)
    short = spellings.where("acronym <> ''").select(F.col("key").alias("a"), F.concat(F.lit("a|"), "acronym").alias("b")).where("a <> b")
    parts = components(found.unionByName(short))
    return spellings.join(parts, spellings["key"] == parts["node"], "left").select("name", F.coalesce("component", "key").alias("entity"))


def pairs(found: DataFrame, salts: int = 8) -> DataFrame:
    """(name_a, name_b), name_a < name_b, of every two spellings of one entity.

    One side is salted and the other repeated for each salt, so that an entity with very
    many spellings is spread over tasks.
    """
    left = found.select("entity", F.col("name").alias("name_a"), F.pmod(F.xxhash64("name"), F.lit(salts)).cast("int").alias("salt"))
    right = found.select("entity", F.col("name").alias("name_b"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return left.join(right, ["entity", "salt"]).where("name_a < name_b").select("name_a", "name_b")
