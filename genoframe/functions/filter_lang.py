"""The include/exclude expression language over variant frames, compiled to columns.

Grammar, by rising precedence: ``||`` (or ``|``), ``&&`` (or ``&``), ``!``, comparisons
``== = != < <= > >= ~ !~``, and parentheses; operands are numbers, quoted strings, ``INFO/X``,
``FMT/X`` (or ``FORMAT/X``), ``GT``, ``FILTER``, site columns (QUAL, POS, CHROM, ID, REF, ALT,
N_ALT) and bare tags.  A bare name that is no column or declared tag is a string.

A site passes if any sample passes.  ``&&`` of per-sample terms needs each side to pass in some
sample, not the same one; ``!`` judges the site as a whole.  Comparisons with a missing value are
false, but ``!=`` is true where one side alone is missing and ``== "."`` is true for missing.  Lists
compare any element with any element.  Values compare as numbers where both read as numbers.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKENS = re.compile(r"""\s*(?:(?P<num>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)(?![\w/])|(?P<str>"[^"]*"|'[^']*')|(?P<name>[A-Za-z_][\w./]*)|(?P<op>\|\||&&|==|!=|<=|>=|!~|[=<>~!()&|]))""")
_SITE = {"QUAL": "qual", "POS": "pos", "CHROM": "chrom", "ID": "id", "REF": "ref", "ALT": "alt", "N_ALT": None}
#: Names that class genotypes.
GT_CLASSES = ("het", "hom", "hap", "mis", "alt", "ref", "rr", "ra", "aa", "aA", "r", "a")


@dataclass
class Term:
    """A compiled term: ``site`` whether the site passes, ``samples`` the passing samples' mask or None for site-level terms."""

    site: Column
    samples: Column | None = None


@dataclass
class _Operand:
    kind: str  # num, str, site (column of text or array of text), sample (function of a sample struct), filter, gt
    value: object


class _Parser:
    def __init__(self, text: str, info: set[str], fmt: set[str]):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        text = text.strip()
        while at < len(text):
            m = _TOKENS.match(text, at)
            if not m:
                raise ValueError(f"cannot read the expression at {text[at:at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at, self.info, self.fmt = 0, info, fmt

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *ops: str) -> str | None:
        kind, value = self.peek()
        if kind == "op" and value in ops:
            self.at += 1
            return value
        return None

    def either(self) -> Term:
        left = self.both()
        while self.take("||", "|"):
            left = _or(left, self.both())
        return left

    def both(self) -> Term:
        left = self.negated()
        while self.take("&&", "&"):
            left = _and(left, self.negated())
        return left

    def negated(self) -> Term:
        if self.take("!"):
            return Term(~self.negated().site)
        return self.comparison()

    def comparison(self) -> Term:
        if self.take("("):
            inner = self.either()
            if not self.take(")"):
                raise ValueError("a closing parenthesis is missing")
            return inner
        left = self.operand()
        op = self.take("==", "=", "!=", "<", "<=", ">", ">=", "~", "!~")
        if op is None:
            return _truth(left)
        return _compare(left, "==" if op == "=" else op, self.operand())

    def operand(self) -> _Operand:
        kind, value = self.peek()
        self.at += 1
        if kind == "num":
            return _Operand("num", value)
        if kind == "str":
            return _Operand("str", value[1:-1])
        if kind != "name":
            raise ValueError(f"an operand is missing before {value!r}")
        if value == "GT" or value in ("FMT/GT", "FORMAT/GT"):
            return _Operand("gt", None)
        if value == "FILTER":
            return _Operand("filter", None)
        if value in ("true", "false"):
            return _Operand("bool", value == "true")
        scope, _, tag = value.partition("/")
        if scope == "INFO" and tag:
            return _Operand("site", F.element_at("info", tag))
        if scope in ("FMT", "FORMAT") and tag:
            return _Operand("sample", tag)
        if value == "N_ALT":
            return _Operand("site", F.size("alt").cast("string"))
        if value in _SITE:
            column = F.col(_SITE[value])
            return _Operand("site", F.array_join(column, ",") if value == "ALT" else column.cast("string"))
        if value in self.info and value in self.fmt:
            raise ValueError(f"{value} is declared in INFO and FORMAT; write INFO/{value} or FMT/{value}")
        if value in self.info:
            return _Operand("site", F.element_at("info", value))
        if value in self.fmt:
            return _Operand("sample", value)
        return _Operand("str", value)


def _any(mask: Column) -> Column:
    return F.exists(mask, lambda x: x)


def _or(a: Term, b: Term) -> Term:
    if a.samples is None and b.samples is None:
        return Term(a.site | b.site)
    every = lambda t: F.transform("samples", lambda s: t.site) if t.samples is None else t.samples
    mask = F.zip_with(every(a), every(b), lambda x, y: x | y)
    return Term(a.site | b.site, mask)


def _and(a: Term, b: Term) -> Term:
    if a.samples is None and b.samples is None:
        return Term(a.site & b.site)
    if a.samples is None or b.samples is None:
        site, mask = (a.site, b.samples) if a.samples is None else (b.site, a.samples)
        return Term(a.site & b.site, F.transform(mask, lambda x: x & site))
    return Term(a.site & b.site, F.when(a.site & b.site, F.zip_with(a.samples, b.samples, lambda x, y: x | y)).otherwise(F.transform(a.samples, lambda x: F.lit(False))))


def _truth(x: _Operand) -> Term:
    if x.kind == "bool":
        return Term(F.lit(x.value))
    if x.kind == "site":
        return Term(F.coalesce(x.value != ".", F.lit(False)))
    if x.kind == "sample":
        mask = F.transform("samples", lambda s: F.coalesce(F.element_at(s["data"], x.value) != ".", F.lit(False)))
        return Term(_any(mask), mask)
    raise ValueError("an operand stands where a condition is needed")


def _pair(op: str, a: Column, b: Column) -> Column:
    """Two single texts: numbers if both are, else text."""
    x, y = a.try_cast("double"), b.try_cast("double")
    numeric = x.isNotNull() & y.isNotNull()
    test = {"==": lambda p, q: p == q, "!=": lambda p, q: p != q, "<": lambda p, q: p < q, "<=": lambda p, q: p <= q, ">": lambda p, q: p > q, ">=": lambda p, q: p >= q}[op]
    return F.when(numeric, test(x, y)).otherwise(test(a, b))


def _lists(op: str, a: Column, b: Column) -> Column:
    """Comma lists: any element with any element; missing elements as the module says."""
    if op in ("~", "!~"):
        hit = F.exists(F.split(a, ","), lambda x: F.rlike(x, b))
        return F.when(a.isNull() | (a == ".") | b.isNull(), False).otherwise(hit if op == "~" else ~hit)
    missing_a, missing_b = a.isNull() | (a == "."), b.isNull()
    met = F.exists(F.split(a, ","), lambda x: F.exists(F.split(b, ","), lambda y: _pair(op, x, y)))
    if op == "!=":
        dot = b == "."
        return F.when(dot, ~missing_a).when(missing_a != missing_b, True).when(missing_a, False).otherwise(met)
    if op == "==":
        return F.when(b == ".", F.coalesce(a == ".", F.lit(False))).when(missing_a | missing_b, False).otherwise(met)
    return F.when(missing_a | missing_b | (b == "."), False).otherwise(met)


def alleles(gt: Column) -> Column:
    """Allele numbers of a GT text, null where missing."""
    return F.transform(F.split(gt, r"[/|]"), lambda x: x.try_cast("int"))


def gt_class(gt: Column, name: str) -> Column:
    """Whether a GT text is of a class."""
    a = alleles(gt)
    called, n = F.filter(a, lambda x: x.isNotNull()), F.size(a)
    full = F.size(called) == n
    distinct, none = F.size(F.array_distinct(called)), gt.isNull() | (F.size(called) == 0)
    ref, some_alt = F.exists(called, lambda x: x == 0), F.exists(called, lambda x: x > 0)
    table = {
        "mis": none | ~full, "hap": full & (n == 1), "het": full & (n > 1) & (distinct > 1), "hom": full & (n > 1) & (distinct == 1), "alt": some_alt, "ref": full & ~some_alt,
        "rr": full & (n > 1) & ~some_alt, "ra": full & (n > 1) & ref & some_alt, "aa": full & (n > 1) & ~ref & (distinct == 1), "aA": full & (n > 1) & ~ref & (distinct > 1),
        "r": full & (n == 1) & ref, "a": full & (n == 1) & some_alt,
    }
    out = F.coalesce(table[name], F.lit(False))
    return out if name == "mis" else ~none & out


def _compare(a: _Operand, op: str, b: _Operand) -> Term:
    flip = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}
    if a.kind in ("num", "str") and b.kind not in ("num", "str"):
        return _compare(b, flip.get(op, op), a)
    other = F.lit(str(b.value)) if b.kind in ("num", "str") else None
    if a.kind == "filter":
        names = F.coalesce("filter", F.array())
        if op in ("~", "!~"):
            hit = F.exists(names, lambda x: x.rlike(str(b.value)))
            return Term(hit if op == "~" else ~hit)
        text = F.when(F.size(names) == 0, ".").otherwise(F.array_join(names, ";"))
        return Term(text == other if op == "==" else text != other)
    if a.kind == "gt":
        want = str(b.value)
        if want in GT_CLASSES:
            mask = F.transform("samples", lambda s: gt_class(s["gt"], want) if op == "==" else ~gt_class(s["gt"], want))
        else:
            mask = F.transform("samples", lambda s: _lists(op, F.regexp_replace(s["gt"], r"^(\./\.|\.\|\.)$", "."), other) if op in ("~", "!~") else F.coalesce(s["gt"] == other if op == "==" else s["gt"] != other, F.lit(op == "!=")))
        return Term(_any(mask), mask)
    if a.kind == "sample":
        value = lambda s: F.element_at(s["data"], a.value)
        against = (lambda s: other) if other is not None else (lambda s: F.element_at(s["data"], b.value)) if b.kind == "sample" else (lambda s: b.value)
        absent = lambda s: F.coalesce(value(s), F.lit(".")) if op == "==" else value(s)  # noqa: E731  a missing sample value equals "."
        mask = F.transform("samples", lambda s: F.coalesce(_lists(op, absent(s), against(s)), F.lit(False)))
        return Term(_any(mask), mask)
    if a.kind == "site" and b.kind == "sample":
        return _compare(b, flip.get(op, op), a)
    left = a.value if a.kind == "site" else F.lit(str(a.value))
    return Term(F.coalesce(_lists(op, left, other if other is not None else b.value), F.lit(False)))


def compile_filter(text: str, info: set[str] | None = None, fmt: set[str] | None = None) -> Term:
    """Compiles an expression, with the declared INFO and FORMAT tags, for frames with the columns of a variant."""
    parser = _Parser(text, info or set(), fmt or set())
    term = parser.either()
    if parser.peek()[0] != "end":
        raise ValueError(f"what follows {parser.peek()[1]!r} cannot be read")
    return term


_FORMAT = re.compile(r"%INFO/(\w+)|%(\w+)(?:\{(\d+)\})?|\[((?:[^\]\\]|\\.)*)\]|((?:[^%\[\\]|\\.)+)", re.S)
_ESCAPES = {"\\n": "\n", "\\t": "\t", "\\\\": "\\"}


def compile_format(text: str) -> Column:
    """Compiles a query format: %CHROM %POS %POS0 %END %ID %REF %ALT %FIRST_ALT %QUAL %FILTER %INFO/TAG %N_ALT, and [...] once for each sample with %SAMPLE %GT %TAG."""

    def literal(x: str) -> Column:
        for a, b in _ESCAPES.items():
            x = x.replace(a, b)
        return F.lit(x)

    def dot(c: Column) -> Column:
        return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("."))

    site = {
        "CHROM": lambda: F.col("chrom"), "POS": lambda: F.col("pos").cast("string"), "POS0": lambda: (F.col("pos") - 1).cast("string"), "END": lambda: (F.col("pos") + F.length("ref") - 1).cast("string"),
        "ID": lambda: dot(F.col("id")), "REF": lambda: F.col("ref"), "ALT": lambda: dot(F.array_join("alt", ",")), "FIRST_ALT": lambda: dot(F.get("alt", F.lit(0))), "QUAL": lambda: dot(F.col("qual")),
        "FILTER": lambda: dot(F.array_join("filter", ";")), "N_ALT": lambda: F.size("alt").cast("string"),
    }

    def parts(text: str, sample: Column | None) -> list[Column]:
        out = []
        for m in _FORMAT.finditer(text):
            if m[1]:
                out.append(dot(F.element_at("info", m[1])))
            elif m[2]:
                name = m[2]
                if sample is not None and name == "SAMPLE":
                    c = sample["name"]
                elif sample is not None and name == "GT":
                    c = dot(sample["gt"])
                elif name in site:
                    c = site[name]()
                elif sample is not None:
                    c = dot(F.element_at(sample["data"], name))
                else:
                    raise ValueError(f"%{name} is no site column; write %INFO/{name} or use it in brackets")
                out.append(dot(F.get(F.split(c, ","), F.lit(int(m[3])))) if m[3] else c)
            elif m[4] is not None:
                inner = m[4]
                out.append(_each(inner))
            else:
                out.append(literal(m[5]))
        return out

    def _each(inner: str) -> Column:
        return F.array_join(F.transform("samples", lambda s: F.concat(*parts(inner, s))), "")

    return F.concat(*parts(text, None))
