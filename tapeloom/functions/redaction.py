"""Redaction of credential-shaped values as ordered regular-expression rules.

A value becomes ``[REDACTED:kind]``; the mark has no length or content of the value, and
no rule matches inside a mark, so a second pass changes nothing.  A value is taken whole,
however long; every repetition is bounded or cannot backtrack into itself, since texts
are chosen by strangers.
"""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EDGE = r"(?<![A-Za-z0-9_+/-])"
_VALUE = r"[A-Za-z0-9_+/.=~-]"
#: A value with a digit and a letter: what prose and placeholders have not.
_MIXED = r"(?=[^\s\"']{0,200}[0-9])(?=[^\s\"']{0,200}[A-Za-z])"
_NAMES = r"(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?token|access[_-]?key|private[_-]?key|key)"
#: Words before a hexadecimal run, on its line, that say it is a name of content.
_CUE = r"(?:commit|integrity|sha1|sha256|sha384|sha512|digest|checksum|revision|etag|md5)"

#: (kind, pattern, replacement) in the order of application; $1 and $2 are kept context.
RULES: tuple[tuple[str, str, str], ...] = (
    ("private-key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:[^-]*+-----END [A-Z ]{0,30}PRIVATE KEY-----)?", ""),
    ("jwt", _EDGE + r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", ""),
    ("oauth-token", r"(?i)(\bBearer\s{1,8})(?!\[REDACTED)" + _MIXED + _VALUE + "{16,}+", "$1"),
    ("github-token", _EDGE + r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])", ""),
    ("gitlab-token", _EDGE + r"glpat-[A-Za-z0-9_-]{20,}+", ""),
    ("npm-token", _EDGE + r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])", ""),
    ("hf-token", _EDGE + r"hf_[A-Za-z0-9]{34}(?![A-Za-z0-9])", ""),
    ("google-key", _EDGE + r"AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])", ""),
    ("slack-token", _EDGE + r"xox[abeprs]-[A-Za-z0-9-]{10,}+", ""),
    ("stripe-key", _EDGE + r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}+", ""),
    ("aws-key", _EDGE + r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])", ""),
    ("url-password", r"([a-z][a-z0-9+.-]{1,20}://(?!\[REDACTED)[^\s/:@]++:)(?!\[REDACTED)[^\s/@]++(?=@)", "$1"),
    ("url-user", r"([a-z][a-z0-9+.-]{1,20}://)" + _MIXED + r"[A-Za-z0-9_-]{24,}+(?=@)", "$1"),
    ("assigned-secret", r"(?i)((?<![A-Za-z0-9])" + _NAMES + r"[\"']?\s{0,4}[:=]\s{0,4}[\"']?)(?!\[REDACTED)" + _MIXED + _VALUE + "{8,}+", "$1"),
    ("api-key", _EDGE + r"sk-[A-Za-z0-9_-]{20,}+", ""),
    ("base64-blob", r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z0-9+/]{40})(?!(?<=(?i:" + _CUE + r")[^\n]{0,24})[0-9a-fA-F]{40,2000}+(?![A-Za-z0-9+/_]))" + _MIXED + r"[A-Za-z0-9+/]{40,}+={0,2}", ""),
)
#: Strings of which a text holds one at least where a rule can match.
NEEDS: dict[str, tuple[str, ...]] = {
    "private-key": ("PRIVATE KEY",), "jwt": ("eyJ",), "github-token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "gitlab-token": ("glpat-",), "npm-token": ("npm_",), "hf-token": ("hf_",),
    "google-key": ("AIza",), "slack-token": ("xox",), "stripe-key": ("_live_", "_test_"), "aws-key": ("AKIA", "ASIA"), "url-password": ("://",), "url-user": ("://",), "api-key": ("sk-",),
}
MARK = r"\[REDACTED:[a-z0-9-]+\]"
#: Characters whose compatibility form can hide a credential.
_CONFUSABLE = r"[\x{FF01}-\x{FF5E}\x{2100}-\x{214F}\x{1D400}-\x{1D7FF}\x{2460}-\x{24FF}\x{200B}-\x{200D}]"


#: The same for rules that do not mind case, in lower case; and what a text must match for the one rule without such strings.
NEEDS_LOWER: dict[str, tuple[str, ...]] = {"oauth-token": ("bearer",), "assigned-secret": ("token", "secret", "passw", "pwd", "key")}
#: Tried where a run begins only.
RUN = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}"
OPENING = "[REDACTED:"


def redacted(text: Column) -> Column:
    """The text with marks for all values that a rule matches; a text that no rule can match is only searched for what they need."""
    suspect = F.lit(False)
    for kind, _, _ in RULES:
        suspect = suspect | _can_match(text, kind)
    made = text
    for kind, pattern, context in RULES:
        made = _applied(made, kind, pattern, f"{context}[REDACTED:{kind}]")
    return F.when(suspect, made).otherwise(text)


def _can_match(text: Column, kind: str) -> Column:
    if kind not in NEEDS and kind not in NEEDS_LOWER:
        return text.rlike(RUN)
    searched, needed = (text, NEEDS[kind]) if kind in NEEDS else (F.lower(text), NEEDS_LOWER[kind])
    held = searched.contains(needed[0])
    for other in needed[1:]:
        held = held | searched.contains(other)
    return held


def _applied(text: Column, kind: str, pattern: str, mark: str) -> Column:
    """One rule, tried only on texts that hold what it needs; the text so far is computed once."""
    return F.get(F.transform(F.array(text), lambda x: F.when(_can_match(x, kind), F.regexp_replace(x, pattern, mark)).otherwise(x)), F.lit(0))


def mark_count(text: Column) -> Column:
    return F.when(text.contains(OPENING), F.regexp_count(text, F.lit(MARK))).otherwise(0)


def mark_kinds(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"\[REDACTED:([a-z0-9-]+)\]"), 1)
    return F.when(text.isNull() | text.contains(OPENING), found).otherwise(F.array().cast("array<string>"))


@F.pandas_udf(T.StringType())
def _compatible(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def redact(df: DataFrame, text: str = "text", confusables: bool = True) -> DataFrame:
    """Redacts a column; adds ``redactions`` (marks that are new) and ``possible_confusable_secret``.

    Rows with look-alike characters (wide, mathematical, enclosed) are also tried in
    compatibility form: if only that form has a value, the text becomes its redacted
    compatibility form.  Only such rows meet Python.
    """
    done = df.withColumn("__done", redacted(F.col(text))).withColumn("redactions", mark_count(F.col("__done")) - mark_count(F.col(text)))
    # A text of as many bytes as characters has no such characters.
    strange = F.coalesce((F.octet_length(text) != F.length(text)) & F.col(text).rlike(_CONFUSABLE), F.lit(False))
    finish = lambda d, c, flag: d.withColumn(text, c).withColumn("possible_confusable_secret", flag).drop("__done", "__form", "__more")
    if not confusables:
        return finish(done, F.col("__done"), F.lit(False))
    plain = finish(done.where(~strange), F.col("__done"), F.lit(False))
    other = done.where(strange).withColumn("__form", redacted(_compatible(F.col("__done")))).withColumn("__more", mark_count(F.col("__form")) - mark_count(F.col("__done")))
    hidden = F.col("__more") > 0
    other = other.withColumn("redactions", F.col("redactions") + F.greatest("__more", F.lit(0)))
    return plain.unionByName(finish(other, F.when(hidden, F.col("__form")).otherwise(F.col("__done")), hidden))


#: A string, or what opens, closes or parts values, in JSON text.
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]:,]', re.S)


def _values(text: str, keep_paths: bool) -> list[tuple[int, int]] | None:
    """Where the strings of JSON text stand that are values, not keys, and not below a field named ``path`` or ``*_path``; none where it is no JSON."""
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return None
    # Open objects and lists: whether it is an object, and the name that was at hand before it.
    found: list[tuple[int, int]] = []
    open_: list[tuple[bool, str]] = []
    name, key = "", False
    for m in _TOKEN.finditer(text):
        token = m[0]
        if token in "{[":
            open_.append((token == "{", name))
            key = token == "{"
        elif token in "}]":
            key, name = False, open_.pop()[1]
        elif token == ",":
            key = open_[-1][0]
        elif token == ":":
            key = False
        elif key:
            name = json.loads(token)
        elif not (keep_paths and (name == "path" or name.endswith("_path"))):
            found.append(m.span())
    return found


def _strings(keep_paths: bool):
    @F.pandas_udf("array<string>")
    def strings(texts: pd.Series) -> pd.Series:
        def of(t):
            if t is None:
                return None
            at = _values(t, keep_paths)
            return [t] if at is None else [json.loads(t[a:b]) for a, b in at]

        return texts.map(of)

    return strings


def _replaced(keep_paths: bool):
    @F.pandas_udf(T.StringType())
    def replaced(texts: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
        def of(t, old, new):
            if t is None or list(old) == list(new):
                return t
            at = _values(t, keep_paths)
            if at is None:
                return new[0]
            out, last = [], 0
            for (a, b), x, y in zip(at, old, new, strict=True):
                out += [t[last:a], t[a:b] if x == y else json.dumps(y, ensure_ascii=False)]
                last = b
            return "".join(out) + t[last:]

        return pd.Series([of(*x) for x in zip(texts, before, after, strict=True)], dtype=object)

    return replaced


def redacted_json(text: Column, keep_paths: bool = True) -> Column:
    """JSON text of any shape with every string value redacted, at any depth; keys, and strings below fields named ``path`` or ``*_path``, stay.

    All else, white space and numbers too, stays as it was written.  Text that is no JSON
    (or too deep for a parser) is redacted as plain text.  Strings are found and put back
    in Python; the rules are those of :func:`redacted`.
    """
    found = _strings(keep_paths)(text)
    return _replaced(keep_paths)(text, found, F.transform(found, redacted))


def redacted_variant(value: Column, keep_paths: bool = True) -> Column:
    """A VARIANT with every string value redacted, as :func:`redacted_json` does."""
    return F.parse_json(redacted_json(F.to_json(value), keep_paths))


def measured(samples: DataFrame, expected: dict[str, str] | None = None) -> DataFrame:
    """For each ``kind`` of samples (``text``): how many, marks put in, those of the right kind, and warnings of look-alikes.

    ``expected`` says which mark a kind stands for, where it is not the kind itself.
    """
    done = redact(samples)
    want = F.col("kind")
    for kind, mark in (expected or {}).items():
        want = F.when(F.col("kind") == kind, mark).otherwise(want)
    right = F.size(F.filter(mark_kinds(F.col("text")), lambda k: k == want))
    return done.groupBy("kind").agg(F.count("*").alias("samples"), F.sum("redactions").cast("long").alias("redactions"), F.sum(right).cast("long").alias("right_kind"), F.count_if("possible_confusable_secret").alias("warnings"))


def redact_nested(df: DataFrame, keep_paths: bool = True, policy: str = "enabled") -> DataFrame:
    """Redacts every string of every column, at any depth; not map keys, nor fields named ``path`` or ``*_path``.

    A VARIANT is walked, too; one inside an array or a map is refused, not passed through.

    Adds ``redaction_policy``, which says what was done; ``disabled`` leaves all text alone.
    """
    if policy not in ("enabled", "disabled"):
        raise ValueError("the policy is enabled or disabled")
    marked = df.withColumn("redaction_policy", F.lit(policy))
    if policy == "disabled":
        return marked

    def is_path(name: str) -> bool:
        return keep_paths and (name == "path" or name.endswith("_path"))

    def walk(c: Column, kind: T.DataType, name: str, inner: bool = False) -> Column:
        if isinstance(kind, T.StringType):
            return c if is_path(name) else redacted(c)
        if isinstance(kind, T.VariantType):
            if inner:
                raise ValueError(f"{name}: a VARIANT inside an array or a map cannot be walked; redact it before it is gathered")
            return c if is_path(name) else redacted_variant(c, keep_paths)
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: walk(x, kind.elementType, name, True))
        if isinstance(kind, T.MapType):
            return F.transform_values(c, lambda _, v: walk(v, kind.valueType, name, True))
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[walk(c[f.name], f.dataType, f.name, inner).alias(f.name) for f in kind.fields]))
        return c

    return marked.select(*[walk(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) for f in df.schema.fields], "redaction_policy")
