"""Text normal form, identifiers, hashes and tokens as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All white space that Python's str.split knows.
SPACE = r"(?U)[\s\x1c-\x1f]+"
EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
# Words that carry no meaning in a match.
STOP = """a an and are as at be by for from has have in is it its of on or that the their this to with
within which who will shall such than these those into any all each other using use used""".split()


def nfc(c: Column) -> Column:
    """NFC by the ICU library that Spark carries: a text at a time in the JVM, no batches of texts in Python workers. Texts of ASCII alone stay as they are."""
    composed = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False))  # False: canonical
    return F.when(c.rlike(r"[^\x00-\x7F]"), composed).otherwise(c)


def normalize_text(c: Column) -> Column:
    """NFC, no-break spaces as spaces, no zero-width spaces, runs of white space as one, trimmed; null as empty."""
    c = F.replace(F.translate(nfc(F.coalesce(c, F.lit(""))), " ", " "), F.lit("​"), F.lit(""))
    return F.trim(F.regexp_replace(c, SPACE, " "))


def strip(c: Column) -> Column:
    """The text without white space of any kind at its ends; null as empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), EDGES, "")


def field_hash(c: Column) -> Column:
    return F.sha2(normalize_text(c), 256)


def canonical_key(c: Column) -> Column:
    """Lower case, & as and, the runs of letters and digits joined by spaces."""
    low = F.replace(F.lower(normalize_text(c)), F.lit("&"), F.lit(" and "))
    return F.array_join(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0)), " ")


def canonical_id(c: Column) -> Column:
    """AC-02(01) as AC-2(1), whatever white space stands around it; null for anything else."""
    pattern = r"^([A-Za-z]{2})-0*(\d{1,3})(?:\(0*(\d{1,3})\))?$"
    t = strip(c)
    part = F.regexp_extract(t, pattern, 3)
    name = F.concat(F.upper(F.regexp_extract(t, pattern, 1)), F.lit("-"), F.regexp_extract(t, pattern, 2))
    return F.when(t.rlike(pattern), F.concat(name, F.when(part != "", F.concat(F.lit("("), part, F.lit(")"))).otherwise("")))


def requirement_code(prefix: str, control_id: Column) -> Column:
    return F.concat(F.lit(f"{prefix}-REQ-"), F.translate(control_id, "()", "-"))


def tokens(c: Column) -> Column:
    """Stemmed words of three letters or more that are not in the stop list."""
    words = F.filter(F.regexp_extract_all(F.lower(normalize_text(c)), F.lit("[a-z0-9]+"), F.lit(0)), lambda x: (F.length(x) >= 3) & ~x.isin(STOP))
    singular = lambda x: F.when((F.length(x) > 4) & x.endswith("ies"), F.concat(F.substr(x, F.lit(1), F.length(x) - 3), F.lit("y"))).when((F.length(x) > 3) & x.endswith("s") & ~x.endswith("ss"), F.substr(x, F.lit(1), F.length(x) - 1)).otherwise(x)
    return F.transform(words, singular)
