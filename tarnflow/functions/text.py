"""Text columns. All but NFC and cleaning stay in the JVM; offsets are code points."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from .batches import text_udf

#: Characters and patterns that results depend on.
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
_CONTROL, _BLANK = re.compile(CONTROL), re.compile("\n{3,}")
#: Unicode's white space but \n, where control characters and \r are gone already; single spaces may stay.
_WIDE = r"\t\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACES = re.compile(f"[ {_WIDE}]{{2,}}|[{_WIDE}]")
SENTENCE_END = r"(?<=[.!?。！？])(?U)\s+|\n+"
NEGATIONS = ["không", "chưa", "not", "never", "no"]
MOJIBAKE = "[ÃÂ][\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]|�|â€|ΓÇ"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row: what stands inside another function's lambda would be computed at each step."""
    return F.transform(F.array(value), body)[0]


def _composed(text: str | None) -> str | None:
    return text if text is None or text.isascii() else unicodedata.normalize("NFC", text)


def nfc(text: Column) -> Column:
    """Canonical composition; Spark has no function for it."""
    return text_udf(_composed)(text)


def cleaned(text: str | None) -> str | None:
    """Composed, with \\n line ends, no soft hyphens or control characters, single spaces, trimmed lines, one blank line at most."""
    if text is None:
        return None
    t = _composed(text).replace("\r\n", "\n").replace("\r", "\n").replace("\u00ad", "")
    t = _SPACES.sub(" ", _CONTROL.sub("", t)).replace(" \n", "\n").replace("\n ", "\n")
    return _BLANK.sub("\n\n", t).strip(" \n")


def clean_text(text: Column) -> Column:
    """cleaned() of a column: a text is in Python for its composition anyway, and the rest costs little there."""
    return text_udf(cleaned)(text)


def margin_key(line: Column) -> Column:
    """A line with its numbers made equal, so that page numbers do not tell running heads apart."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(line), r"(?U)\d+", "#"), r"(?U)\s+", " "), F.lit(" "))


def content_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085  ]"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def words(text: Column) -> Column:
    """Runs of letters, digits and underscores of lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), F.lit(1))


def paragraph_spans(text: str) -> Iterator[tuple[str, int, int, int, int]]:
    """text, start and end, first and last line (from 1) of each part between blank lines, without white space at its ends; each line is counted once."""
    line, counted, begin = 1, 0, 0
    for edge in [*re.finditer(r"\n[ \t]*\n", text), None]:
        end = edge.start() if edge else len(text)
        part = text[begin:end]
        a, z = end - len(part.lstrip()), begin + len(part.rstrip())
        if a < z:
            first = line + text.count("\n", counted, a)
            line = first + text.count("\n", a, z)
            counted = z
            yield text[a:z], a, z, first, line
        begin = edge.end() if edge else end


def terms(text: Column) -> Column:
    """Distinct words of two characters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w{2,})"), F.lit(1)))


def overlap(a: Column, b: Column) -> Column:
    """How many terms two texts share: the stand-in for a cross-encoder, not a model."""
    return shared(terms(a), terms(b))


def shared(a: Column, b: Column) -> Column:
    """How many terms two arrays of them share."""
    return F.size(F.array_intersect(a, b)).cast("double")


def tail(text: Column, limit: Column) -> Column:
    """At most the last limit characters, from after the first space in them if there is one."""
    last = F.substring(text, F.length(text) - limit + 1, limit)
    space = F.instr(last, " ")
    cut = F.when(space > 0, F.substring(last, space + 1, limit)).otherwise(last)
    return F.when((limit <= 0) | (F.length(text) == 0), "").when(F.length(text) <= limit, text).otherwise(cut)


def corrupted(text: Column) -> Column:
    """Signs of text decoded under a wrong encoding."""
    return text.rlike(MOJIBAKE) | text.rlike("(?U)\\w´(?=\\s|$)")


def claim_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)([^\W_]+)"), F.lit(1))


def reverses_negation(claim: Column, source: Column) -> Column:
    """The claim states, without a negation in the five words before, two words that the source negates."""
    no = F.array(*(F.lit(x) for x in NEGATIONS))

    def negated(s: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(s) - 3, F.lit(0))), lambda i: (i < F.size(s) - 2) & F.array_contains(no, F.get(s, i)) & (F.get(s, i + 1) != "chỉ"))
        return F.array_distinct(F.transform(places, lambda i: F.concat_ws(" ", F.get(s, i + 1), F.get(s, i + 2))))

    def stated(c: Column, turned: Column) -> Column:
        def at(p: Column) -> Column:
            prior = F.slice(c, F.greatest(p - 4, F.lit(1)), F.least(p, F.lit(5)))
            return F.array_contains(turned, F.concat_ws(" ", F.get(c, p), F.get(c, p + 1))) & ~F.arrays_overlap(prior, no)

        return F.when(F.size(turned) == 0, False).otherwise(F.exists(F.sequence(F.lit(0), F.greatest(F.size(c) - 2, F.lit(0))), at))

    return bound(bound(claim_words(source), negated), lambda turned: bound(claim_words(claim), lambda c: stated(c, turned)))
