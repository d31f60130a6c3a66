"""Words, keywords, previews and slugs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions.kinds import strip

# Words that carry no topic in prompts.
STOP_WORDS = tuple(
    """
    i me my mine myself you your yours yourself yourselves he him his himself she her hers herself it its itself we us our ours
    ourselves they them their theirs themselves a an the this that these those some any all each every no none other another
    several many much few am is are was were be been being have has had having do does did doing will would shall should may
    might must can could of for to from with without in on at by as about against between into through during before after
    above below up down over under within among and or but if then else so because while although though since unless until
    what which who whom whose where when why how remind tell show explain describe give help please thanks thank like want need
    think know ok okay sure also just only very really maybe probably here there now today yesterday tomorrow again still
    already yet anymore not nor too than s t m d ll re ve
    """.split()
)
KEYWORD = r"[A-Za-z][A-Za-z0-9_\-]+"
LABEL_WORD = "[a-z][a-z0-9]+"
PREVIEW = 200


def native_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; without stems, for corpora where native speed counts more."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def keywords(prompt: str, min_len: int = 3) -> list[str]:
    """Keywords of one prompt: quoted phrases first, as written, then words that aren't stop words, lower-cased; each once."""
    phrases = [p.strip() for p in re.findall('"([^"]+)"', prompt or "")]
    words = [w.lower() for w in re.findall(KEYWORD, re.sub('"[^"]+"', " ", prompt or ""))]
    found = [p for p in phrases if p] + [w for w in words if len(w) >= min_len and w not in STOP_WORDS]
    first: dict[str, str] = {}
    for k in found:
        first.setdefault(k.lower(), k)
    return list(first.values())


def keywords_of(prompt: Column, min_len: int = 3) -> Column:
    """keywords() of a column without quoted phrases, natively."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    words = F.transform(F.regexp_extract_all(prompt, F.lit(KEYWORD), F.lit(0)), F.lower)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= min_len) & ~F.array_contains(stop, w)))


def any_of(words: list[str]) -> str:
    """A query that asks for any of the keywords; those of several words as phrases."""
    return " OR ".join('"' + w.replace('"', '""') + '"' if " " in w else w for w in words)


def sanitized(query: str) -> str:
    """A query that always parses: its words, quoted, any of them."""
    return " OR ".join(f'"{w}"' for w in re.findall("[A-Za-z0-9_]+", query))


def label_words(content: Column) -> Column:
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(F.regexp_extract_all(F.lower(content), F.lit(LABEL_WORD), F.lit(0)), lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w))


def preview(content: Column, n: int = PREVIEW) -> Column:
    """The content on one line, cut after n characters."""
    flat = strip(F.replace(content, F.lit("\n"), F.lit(" ")))
    return F.when(F.length(flat) <= n, flat).otherwise(F.concat(F.regexp_replace(F.substring(flat, 1, n), r"\s+$", ""), F.lit("...")))


def slug_of(path: Column) -> Column:
    """A path's slug: a drive letter lower-cased, colon and separators as dashes."""
    low = F.when(path.rlike("^[A-Za-z]:"), F.concat(F.lower(F.substring(path, 1, 1)), F.substring(path, 2, 1 << 30))).otherwise(path)
    return F.translate(low, ":\\/", "---")


def path_of(slug: Column) -> Column:
    """The path a slug with a drive letter most likely stands for; null for other slugs."""
    return F.when(slug.rlike("^[A-Za-z]--."), F.concat(F.substring(slug, 1, 1), F.lit(":/"), F.replace(F.substring(slug, 4, 1 << 30), F.lit("-"), F.lit("/"))))


def session_id_of(relative: Column) -> Column:
    """A session's id by its file's path below the project: folders joined by two dashes, without the ending."""
    return F.replace(F.regexp_replace(relative, r"\.jsonl$", ""), F.lit("/"), F.lit("--"))
