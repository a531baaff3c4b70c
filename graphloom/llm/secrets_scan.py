"""Secret scans with a trigram index, in DataFrame functions only.

Each rule's regular expression is parsed into a Boolean query over trigrams that any match must contain (lower-cased). The
index is cut by documents: for each trigram that a query names, a column of bits, one per text, says whether the text has
it. AND and OR over these columns intersect and unite postings; only texts that answer a rule's query are matched with its
expression, which gives exact spans. A rule without a mandatory trigram, such as long hexadecimal runs, scans every text.

Everything stays within a row: no shuffle, no join, nothing to skew.

Defined results: a null text counts as empty, and has no span; repeated rows are scanned each on its own. Positions are code
points. Spans come by start, then by the order of kinds; spans of different kinds may overlap.
"""

from __future__ import annotations

import re._constants as _c
import re._parser as _p
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import let, read_table


@dataclass(frozen=True)
class Rule:
    """kind; expression in the syntax common to Java and Python; the group that is the secret, and its least length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The first three are the base kinds.
RULES = (
    Rule("assign", _ASSIGN, 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    # to the key's end, if it has one; a few hyphens stand in headers such as those of encrypted keys
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*(?:-[^-]+){0,8}-----END [A-Z ]*PRIVATE KEY-----)?"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)
BASE = ("assign", "access", "hex")
#: Alternatives that a rule's query may have.
MOST_ALTERNATIVES = 64
#: Characters up to which a class counts as alternatives.
SMALL_CLASS = 8
_BREAK = "\0"


def _runs(tree) -> list[str]:
    """Alternatives of what a match must contain: literal text, with _BREAK where other text may stand."""
    out = [""]
    for op, arg in tree:
        if op is _c.LITERAL:
            more = [chr(arg).lower()]
        elif op is _c.SUBPATTERN:
            more = _runs(arg[3])
        elif op is _c.BRANCH:
            more = [x for branch in arg[1] for x in _runs(branch)]
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT):
            least, most, sub = arg
            inner = _runs(sub)
            if least == 0 and most == 1 and all(_BREAK not in x for x in inner):
                more = ["", *inner]
            elif least == 0:
                more = [_BREAK]
            elif least == most == 1:
                more = inner
            else:
                more = [_BREAK + x + _BREAK for x in inner]
        elif op is _c.AT:
            more = [""]
        elif op is _c.IN and len(arg) <= SMALL_CLASS and all(kind is _c.LITERAL for kind, _ in arg):
            more = [chr(x).lower() for _, x in arg]
        else:
            more = [_BREAK]
        more = list(dict.fromkeys(more))
        # what has too many alternatives may be anything
        out = [a + b for a in out for b in (more if len(out) * len(more) <= MOST_ALTERNATIVES else [_BREAK])]
    return out


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """An OR of ANDs of trigrams that every match contains; None if a match may do without any."""
    alternatives = {frozenset(run[k : k + 3] for run in x.split(_BREAK) for k in range(len(run) - 2)) for x in _runs(_p.parse(pattern))}
    if frozenset() in alternatives:
        return None
    return sorted((a for a in alternatives if not any(b < a for b in alternatives)), key=sorted)


def _is(field: str, value):
    """A lambda of one argument for a span's field."""
    return lambda s: s[field] == value


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0), lambda a, b: a + b)


_STEP = 128


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Structs (start, ord, kind, end) of a rule's matches in a text; starts are running sums, in steps, of what lies between."""
    pattern = F.lit(rule.pattern)
    kept = F.regexp_extract_all(text, pattern, F.lit(rule.group))

    def placed(v: Column) -> Column:
        n = F.size(v["all"])
        # text before each match, with the match before that
        gaps = F.transform(F.slice(v["between"], 1, n), lambda x, i: F.length(x) + F.when(i == 0, 0).otherwise(F.length(F.get(v["all"], i - 1))))
        return let(F.struct(gaps.alias("gaps"), v["all"].alias("all"), v["kept"].alias("kept")), stepped)

    def stepped(v: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(0), F.floor((F.size(v["gaps"]) - 1) / _STEP).cast("int")), lambda b: _total(F.slice(v["gaps"], b * _STEP + 1, _STEP)))
        return let(F.struct(v["gaps"].alias("gaps"), v["all"].alias("all"), v["kept"].alias("kept"), steps.alias("steps")), spans)

    def spans(v: Column) -> Column:
        def span(match: Column, i: Column) -> Column:
            b = F.floor(i / _STEP).cast("int")
            start = _total(F.slice(v["steps"], 1, b)) + _total(F.slice(v["gaps"], b * _STEP + 1, i % _STEP + 1))
            return let(start, lambda s: F.struct(s.alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), (s + F.length(match)).alias("end"), F.length(F.get(v["kept"], i)).alias("n")))

        return F.transform(F.filter(F.transform(v["all"], span), lambda s: s["n"] >= rule.least), lambda s: F.struct(s["start"], s["ord"], s["kind"], s["end"]))

    found = let(F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("all"), F.split(text, rule.pattern).alias("between"), kept.alias("kept")), placed)
    return F.when(F.regexp_like(text, pattern), found)


_NONE = "array<struct<start:int,ord:int,kind:string,end:int>>"


def scan(docs: DataFrame, *, text_col: str = "text", rules: tuple[Rule, ...] = RULES, spans_col: str = "secret_spans") -> DataFrame:
    """docs with an array of (start, ord, kind, end) structs, sorted; an existing column of that name is replaced."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    queries = {r: trigram_query(r.pattern) for r in rules}
    trigrams = sorted({t for q in queries.values() for a in q or () for t in a})
    index = F.struct(*(F.contains(F.col("__gl_lower"), F.lit(t)).alias(f"t{k}") for k, t in enumerate(trigrams)))
    posting = {t: F.col(f"__gl_index.t{k}") for k, t in enumerate(trigrams)}

    def answers(query) -> Column:
        some = F.lit(False)
        for every in query:
            has = F.lit(True)
            for t in sorted(every):
                has &= posting[t]
            some |= has
        return some

    found = [F.coalesce(_spans(text, r, k) if queries[r] is None else F.when(answers(queries[r]), _spans(text, r, k)), F.array().cast(_NONE)) for k, r in enumerate(rules)]
    # the index stands in front of what asks it, in a step of its own
    indexed = docs.drop(spans_col).withColumn("__gl_lower", F.lower(text)).withColumn("__gl_index", index if trigrams else F.lit(None))
    return indexed.withColumn(spans_col, F.array_sort(F.concat(*found))).drop("__gl_lower", "__gl_index")


def redact(docs: DataFrame, *, text_col: str = "text", n_chars_col: str | None = "n_chars", rules: tuple[Rule, ...] = RULES, mark: str = "[REDACTED]") -> DataFrame:
    """docs with the found secrets replaced by mark, in texts that have any; n_chars_col, if docs has it, is counted anew for these. No row goes."""
    spans, text = "__gl_spans", F.col(f"`{text_col}`")
    scanned = scan(docs, text_col=text_col, rules=rules, spans_col=spans)
    clean = text
    for k, r in enumerate(rules):
        # the part before the secret stays; of the secret, nothing
        pattern = r.pattern if not r.group else r.pattern.removesuffix("([A-Za-z0-9+/_.=-]+)") + "([A-Za-z0-9+/_.=-]{%d,})" % r.least
        pattern = pattern if r.kind != "access" else r"AKIA[A-Z0-9]{12,}"
        if r.group:
            pattern = pattern.replace("((?i:", "((?i:", 1)
            start = pattern.rindex("(")
            pattern = f"({pattern[:start]}){pattern[start:]}"
        replaced = F.regexp_replace(clean, F.lit(pattern), F.lit(("$1" if r.group else "") + mark.replace("$", r"\$")))
        clean = F.when(F.exists(spans, _is("ord", k)), replaced).otherwise(clean)
    columns = {text_col: F.when(F.size(spans) > 0, clean).otherwise(text)}
    out = scanned.withColumns(columns)
    if n_chars_col in docs.columns:
        out = out.withColumn(n_chars_col, F.when(F.size(spans) > 0, F.length(text).cast(docs.schema[n_chars_col].dataType)).otherwise(F.col(f"`{n_chars_col}`")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: counts of the base kinds, the digest of their spans, and all spans."""
    docs = scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"), spans_col="found").select("doc_id", "found")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    count = {k: F.size(F.filter("found", _is("kind", k))).cast("long").alias(f"n_{k}") for k in BASE}
    base = F.filter("found", lambda s: s["ord"] < len(BASE))
    return docs.select("doc_id", *count.values(), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
