"""Full-text search: an inverted index as ordinary tables, a query language, BM25 and snippets.

index() makes postings (term, msg_id, tf, positions) and document lengths; both are plain tables that can be written sorted or
bucketed by term and refreshed by message. A query is parsed on the driver; all of its phrases are evaluated in one aggregation
of the postings of its terms by message, after which truth and score are plain column expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.stems import fold, stem, stemmed_lengths, stemmed_texts
from threadloom.functions.words import native_tokens

K1, B, RARE_IDF = 1.2, 0.75, 1e-6
MARK, END_MARK, CUT, SNIPPET_TOKENS = "<mark>", "</mark>", "...", 24
NEAR_DISTANCE = 10


class QueryError(ValueError):
    """A query that can't be parsed."""


@dataclass
class Phrase:
    words: list[str]
    prefix: bool = False
    first: bool = False
    number: int = -1


@dataclass
class Near:
    phrases: list[Phrase]
    distance: int = NEAR_DISTANCE


@dataclass
class Op:
    name: str
    parts: list = field(default_factory=list)


_TOKEN = re.compile(r'\s*(?:("(?:[^"]|"")*")|([\w\x80-\U0010ffff]+)|([()+*:^,]))')


def _lex(query: str) -> list[tuple[str, str]]:
    out, at = [], 0
    query = query.rstrip()
    while at < len(query):
        m = _TOKEN.match(query, at)
        if not m:
            raise QueryError(f"unexpected {query[at:].lstrip()[:1]!r} in {query!r}")
        at = m.end()
        if m[1] is not None:
            out.append(("text", m[1][1:-1].replace('""', '"')))
        elif m[2] is not None:
            out.append(("word", m[2]))
        else:
            out.append(("mark", m[3]))
    return out


class _Parser:
    """or: and (OR and)*; and: not (AND not)*; not: run (NOT run)*; run: one or more primaries side by side, all required."""

    def __init__(self, query: str, split):
        self.tokens, self.at, self.split = _lex(query), 0, split
        if not self.tokens:
            raise QueryError("empty query")
        self.phrases: list[Phrase] = []

    def peek(self, ahead: int = 0):
        k = self.at + ahead
        return self.tokens[k] if k < len(self.tokens) else ("end", "")

    def take(self, kind: str, value: str | None = None) -> str:
        t = self.peek()
        if t[0] != kind or value is not None and t[1] != value:
            raise QueryError(f"expected {value or kind}, found {t[1] or 'the end'!r}")
        self.at += 1
        return t[1]

    def chain(self, name: str, below):
        parts = [below()]
        while self.peek() == ("word", name):
            self.at += 1
            parts.append(below())
        return parts[0] if len(parts) == 1 else Op(name, parts)

    def parse(self):
        tree = self.either()
        if self.peek()[0] != "end":
            raise QueryError(f"unexpected {self.peek()[1]!r}")
        return tree

    def either(self):
        return self.chain("OR", self.both)

    def both(self):
        return self.chain("AND", self.without)

    def without(self):
        return self.chain("NOT", self.run)

    def run(self):
        parts = [self.primary()]
        while self.peek()[0] == "text" or self.peek()[0] == "word" and self.peek()[1] not in ("AND", "OR", "NOT") or self.peek() in (("mark", "("), ("mark", "^")):
            parts.append(self.primary())
        return parts[0] if len(parts) == 1 else Op("AND", parts)

    def primary(self):
        if self.peek() == ("mark", "("):
            self.at += 1
            tree = self.either()
            self.take("mark", ")")
            return tree
        if self.peek()[0] == "word" and self.peek(1) == ("mark", ":"):
            if self.peek()[1].lower() != "content":
                raise QueryError(f"no such column: {self.peek()[1]}")
            self.at += 2
            return self.primary()
        if self.peek() == ("word", "NEAR") and self.peek(1) == ("mark", "("):
            self.at += 2
            found, distance = [], NEAR_DISTANCE
            while self.peek() not in (("mark", ")"), ("mark", ",")):
                found.append(self.phrase())
            if self.peek() == ("mark", ","):
                self.at += 1
                number = self.take("word")
                if not number.isdigit():
                    raise QueryError("NEAR needs a number")
                distance = int(number)
            self.take("mark", ")")
            if not found:
                raise QueryError("empty NEAR")
            return Near(found, distance)
        return self.phrase()

    def phrase(self) -> Phrase:
        first = self.peek() == ("mark", "^")
        self.at += first
        words, prefix = [], False
        while True:
            kind, value = self.peek()
            if kind not in ("word", "text") or kind == "word" and value in ("AND", "OR", "NOT"):
                raise QueryError(f"expected a word, found {value or 'the end'!r}")
            self.at += 1
            words += self.split(value)
            if self.peek() == ("mark", "*"):
                self.at += 1
                prefix = True
            if self.peek() != ("mark", "+"):
                break
            self.at += 1
        p = Phrase(words, prefix, first, len(self.phrases))
        self.phrases.append(p)
        return p


def stemmed_words(text: str) -> list[str]:
    return [stem(w) for w in re.findall(r"[^\W_]+", fold(text))]


def plain_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def parse_query(query: str, stemmed: bool = True):
    """(tree, phrases) of a query. Raises QueryError."""
    p = _Parser(query, stemmed_words if stemmed else plain_words)
    return p.parse(), p.phrases


@dataclass
class Index:
    postings: DataFrame
    doc_stats: DataFrame
    stemmed: bool = True


def index(messages: DataFrame, stemmed: bool = True) -> Index:
    """Postings and lengths of messages (msg_id, content). Null contents have no terms and length 0. Positions count from 0."""
    if stemmed:
        split, lengths = stemmed_texts(messages, "msg_id", "content"), stemmed_lengths(messages, "msg_id", "content")
    else:
        split = messages.select("msg_id", F.coalesce(native_tokens(F.col("content")), F.array().cast("array<string>")).alias("tokens"))
        lengths = split.select("msg_id", F.size("tokens").alias("dl"))
    postings = split.select("msg_id", F.posexplode_outer("tokens").alias("pos", "term")).where("term is not null").groupBy("term", "msg_id").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))
    return Index(postings, lengths, stemmed)


def refresh(old: Index, changed: DataFrame, deleted: DataFrame) -> Index:
    """The index after messages (of `changed`) were added or altered and ids (of `deleted`) removed: only their rows are made anew."""
    gone = deleted.select("msg_id").unionByName(changed.select("msg_id")).distinct()
    new = index(changed, old.stemmed)
    return Index(old.postings.join(gone, "msg_id", "left_anti").select(*old.postings.columns).unionByName(new.postings), old.doc_stats.join(gone, "msg_id", "left_anti").unionByName(new.doc_stats), old.stemmed)


def corpus_stats(idx: Index) -> DataFrame:
    return idx.doc_stats.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_tokens"))


def _starts(p: Phrase) -> Column:
    """Places where the phrase begins in a message, from the aggregated positions of its words."""
    places = [F.col(f"p{p.number}_{j}") for j in range(len(p.words))]
    out = places[0]
    for j, c in enumerate(places[1:], 1):
        out = F.array_intersect(out, _shifted(c, j))
    return F.filter(out, lambda x: x == 0) if p.first else out


def _shifted(places: Column, by: int) -> Column:
    return F.transform(places, lambda x: x - by)


def _close(places: Column, length: int, others: Column, other_length: int, distance: int) -> Column:
    """Places from which a phrase has one of the others, at most `distance` words between them."""
    return F.filter(places, lambda x: F.exists(others, lambda y: F.when(y >= x, y - x - length).otherwise(x - y - other_length) <= distance))


def _positions(p: Phrase) -> list[Column]:
    out = []
    for j, w in enumerate(p.words):
        is_it = F.col("term").startswith(w) if p.prefix and j == len(p.words) - 1 else F.col("term") == w
        out.append(F.coalesce(F.array_distinct(F.flatten(F.collect_list(F.when(is_it, F.col("positions"))))), F.array().cast("array<int>")).alias(f"p{p.number}_{j}"))
    return out


def _near(node: Near) -> dict[int, Column]:
    """Places of each phrase that take part: every other phrase begins close enough."""
    out = {}
    for p in node.phrases:
        ok = F.col(f"s{p.number}")
        for q in node.phrases:
            if q is not p:
                ok = _close(ok, len(p.words), F.col(f"s{q.number}"), len(q.words), node.distance)
        out[p.number] = ok
    return out


def _nears(tree) -> list[Near]:
    return [tree] if isinstance(tree, Near) else [n for x in tree.parts for n in _nears(x)] if isinstance(tree, Op) else []


def _true(node) -> Column:
    if isinstance(node, Phrase):
        return F.col(f"tf{node.number}") > 0
    if isinstance(node, Near):
        return _all(F.col(f"tf{p.number}") > 0 for p in node.phrases)
    parts = [_true(x) for x in node.parts]
    if node.name == "OR":
        return ~_all(~x for x in parts)
    return parts[0] & _all(~x for x in parts[1:]) if node.name == "NOT" else _all(parts)


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _scores(node, gate: Column, weight) -> list[Column]:
    """Terms of the score: each phrase where all that surrounds it holds; what follows NOT adds nothing."""
    if isinstance(node, Phrase):
        return [F.when(gate & _true(node), weight(node)).otherwise(0.0)]
    inner = gate & _true(node) if not (isinstance(node, Op) and node.name == "OR") else gate
    parts = node.phrases if isinstance(node, Near) else node.parts[:1] if node.name == "NOT" else node.parts
    return [s for x in parts for s in _scores(x, inner, weight)]


def search_index(idx: Index, query: str) -> DataFrame:
    """(msg_id, score) of the messages that the query matches; score is BM25, higher is better. Statistics cover the whole index. Raises QueryError."""
    tree, phrases = parse_query(query, idx.stemmed)
    live = [p for p in phrases if p.words]
    for p in phrases:
        if not p.words:
            raise QueryError("a phrase without words")
    exact = sorted({w for p in live for w in (p.words[:-1] if p.prefix else p.words)})
    condition = F.col("term").isin(exact)
    for p in live:
        if p.prefix:
            condition = condition | F.col("term").startswith(p.words[-1])
    hits = idx.postings.where(condition).groupBy("msg_id").agg(*[c for p in live for c in _positions(p)])
    hits = hits.select("msg_id", *[_starts(p).alias(f"s{p.number}") for p in live])
    narrowed = {k: c for n in _nears(tree) for k, c in _near(n).items()}
    hits = hits.select("msg_id", *[F.size(narrowed.get(p.number, F.col(f"s{p.number}"))).alias(f"tf{p.number}") for p in live], *[(F.size(f"s{p.number}") > 0).alias(f"has{p.number}") for p in live])
    stats = hits.agg(*[F.count_if(f"has{p.number}").alias(f"n{p.number}") for p in live]).crossJoin(F.broadcast(corpus_stats(idx)))

    def weight(p: Phrase) -> Column:
        n, tf = F.col(f"n{p.number}"), F.col(f"tf{p.number}")
        idf = F.ln((F.col("n_docs") - n + 0.5) / (n + 0.5))
        length = F.col("dl") / (F.col("total_tokens") / F.col("n_docs"))
        return F.when(idf > 0, idf).otherwise(RARE_IDF) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length))

    total = F.lit(0.0)
    for s in _scores(tree, F.lit(True), weight):
        total = total + s
    return hits.where(_true(tree)).join(idx.doc_stats, "msg_id").crossJoin(F.broadcast(stats)).select("msg_id", total.alias("score"))


def snippet(text: str, phrases: list[list[str]], stemmed: bool = True, size: int = SNIPPET_TOKENS, marks: tuple[str, str] = (MARK, END_MARK)) -> str:
    """At most `size` tokens of the text around the window that holds most different phrases, the earliest of such; matches are marked."""
    spans = [m.span() for m in re.finditer(r"[^\W_]+", text or "")]
    words = [(stem(fold(text[a:b])) if stemmed else text[a:b].lower()) for a, b in spans]
    found = [(i, i + len(p), k) for k, p in enumerate(phrases) for i in range(len(words) - len(p) + 1) if p and words[i : i + len(p)] == p]
    found.sort()
    start = 0
    if len(words) > size and found:
        best = (-1, 0)
        for i, _, _ in found:
            inside = [f for f in found if i <= f[0] and f[1] <= i + size]
            kinds = len({f[2] for f in inside})
            if kinds > best[0]:
                spare = (size - (max(f[1] for f in inside) - i)) // 2 if inside else 0
                best = (kinds, max(0, min(i - spare, len(words) - size)))
        start = best[1]
    end = min(len(words), start + size)
    if not spans:
        return text or ""
    a = 0 if start == 0 else spans[start][0]
    b = len(text) if end == len(words) else spans[end - 1][1]
    out, at = [], a
    covered: list[tuple[int, int]] = []
    for s, e, _ in found:
        if start <= s and e <= end and (not covered or s >= covered[-1][1]):
            covered.append((s, e))
    for s, e in covered:
        out += [text[at : spans[s][0]], marks[0], text[spans[s][0] : spans[e - 1][1]], marks[1]]
        at = spans[e - 1][1]
    out.append(text[at:b])
    return (CUT if start else "") + "".join(out) + (CUT if end < len(words) else "")


def snippets(content: Column, query: str, stemmed: bool = True) -> Column:
    """snippet() of a column; for the few rows of a result, not a corpus."""
    phrases = [p.words for p in parse_query(query, stemmed)[1]]

    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: snippet(t, phrases, stemmed))

    return run(content)
