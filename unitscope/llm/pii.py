"""Format-preserving pseudonyms for personal data.

Card numbers (Luhn), social security numbers (issued ranges), telephone numbers, IPv4 addresses and
calendar dates are found by pattern, validated, and replaced by a keyed permutation of all values of
their kind and format: a Feistel network that adds a keyed hash of one part to the other, modulo the
number of values of that part, for ROUNDS rounds. So a valid value becomes another valid value in the
same layout, equal values become equal values in every document, no two values become the same, and
who has the key can invert it (`inverse`). Where only some of a network's values have the layout, the
permutation is repeated until it meets one of them (cycle walking): dates of month and day stay such
dates, years stay between 0001 and 9999, and addresses with leading zeros keep them. E-mail addresses and secrets after words like "token =" have
no such format; they become keyed hashes, equal for equal values.

A card may stand in a longer run of digit groups, before or after other numbers: every stretch of 13 to 19
digits that begins and ends with a group is validated, usual card layouts first, then from the left and the
longest first, and none that overlap are both taken. (Where stretches overlap, a pseudonym can give another
of them a Luhn sum, and `inverse` may then take that one.)

Numbers that fail their validation, such as 16 digits without a Luhn sum, are left alone. Null texts
stay null, empty ones empty; repeated rows are treated alike. All is one expression over each text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from unitscope.llm.parsing import parsed_once
from unitscope.llm.quality import let, running

ROUNDS = 10
#: For tests and for sessions that set no KEY_SETTING; whoever knows the key can invert the pseudonyms.
DEMO_KEY = "unitscope demonstration key"
KEY_SETTING = "spark.unitscope.pii.key"

_SECRET = r"(?i:token|secret|password|passwd|api[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?"
#: What a further group of digits may not begin, since it is of another kind.
_SLASHED = r"\d{2}[/.]\d{2}[/.]\d{4}(?![\d/])|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)"
_DASHED = r"(?:\d{4}-\d{2}-\d{2}|\d{3}-\d{2}-\d{4}|\d{3}-\d{3}-\d{4})(?![\d-])"

#: Patterns of candidates by kind, tried in this order at each place. Repeated groups are bounded or possessive: Java tries again by recursion.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})++",
    # What can be seen at the place itself is tried before the words that stand before it.
    "secret": rf"(?<=[=:\s\"'])(?=[A-Za-z0-9_+/-]{{16}})(?<={_SECRET})[A-Za-z0-9_+/-]{{16,}}",
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)",
    "date": r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])|(?<![\d/.])\d{2}([/.])\d{2}\1\d{4}(?![\d/])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w+])\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])",
    # Whole runs of groups; possessive, since a run can be long.
    "card": rf"(?<![\dA-Za-z+])(?=\d(?:[ -]?\d){{12}})\d++(?![A-Za-z])(?:(?: (?!{_DASHED}|{_SLASHED})|-(?!{_SLASHED}))\d++(?![A-Za-z]))*+",
}
#: A card of 19 digits has so many groups at most.
MOST_GROUPS = 19
_EPOCH, _CYCLE = "DATE'1700-01-01'", 146097
#: Steps of a walk at most: of random permutations not one value in 10**18 needs more.
WALK = 512


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


class _Sql:
    """SQL of the pseudonym of a candidate x, for one key and direction."""

    def __init__(self, key: str, inverse: bool) -> None:
        self.key, self.inverse = _quoted(key), inverse

    def feistel(self, left: str, right: str, a: str, b: str, tweak: str) -> str:
        """Struct (l, r): left below a and right below b, permuted together."""
        f = lambda v: f"cast(conv(substr(sha2(concat_ws('|', {self.key}, {tweak}, i, {v}), 256), 1, 15), 16, 10) AS bigint)"
        sign, turns = ("-", f"sequence({ROUNDS - 1}, 0, -1)") if self.inverse else ("+", f"sequence(0, {ROUNDS - 1})")
        return (
            f"aggregate({turns}, struct(cast({left} AS bigint) AS l, cast({right} AS bigint) AS r), (s, i) -> if(i % 2 = 0,"
            f" struct(pmod(s.l {sign} {f('s.r')}, cast({a} AS bigint)) AS l, s.r AS r), struct(s.l AS l, pmod(s.r {sign} {f('s.l')}, cast({b} AS bigint)) AS r)))"
        )

    @staticmethod
    def luhn(digits: str, table: str = "_t.even") -> str:
        """The Luhn sum of a string of at most 20 digits that an even or an odd number of others follow, from tables of pairs of digits."""
        pairs = lambda v, n: " + ".join(f"{table}[int(({v} div {100**k}L) % 100)]" for k in range(n))
        whole = lambda n: let(f"cast({digits} AS bigint)", "_h", pairs("_h", n))
        halves = let(f"struct(cast(substr({digits}, 1, length({digits}) - 10) AS bigint) AS a, cast(right({digits}, 10) AS bigint) AS b)", "_h", f"{pairs('_h.a', 5)} + {pairs('_h.b', 5)}")
        return f"CASE WHEN length({digits}) = 0 THEN 0 WHEN length({digits}) <= 2 THEN {table}[int({digits})] WHEN length({digits}) <= 4 THEN {whole(2)} WHEN length({digits}) <= 10 THEN {whole(5)} ELSE {halves} END"

    @staticmethod
    def laid(digits: str) -> str:
        """x with its digits replaced in order."""
        return let(digits, "n", "aggregate(split(x, ''), struct(0 AS k, '' AS out), (s, c) -> if(c RLIKE '^[0-9]$', struct(s.k + 1 AS k, concat(s.out, substr(n, s.k + 1, 1)) AS out), struct(s.k AS k, concat(s.out, c) AS out))).out")

    def card(self) -> str:
        """Of the groups g of a run and their separators p. Whatever is asked about a group looks at the MOST_GROUPS beside it at most."""
        half, rest = "((length(d) - 2) div 2)", "(length(d) - 2 - (length(d) - 2) div 2)"
        left, right = f"substr(d, 2, int({half}))", f"substr(d, int({half}) + 2, int({rest}))"
        body = let(self.feistel(left, right, f"rpad('1', int({half}) + 1, '0')", f"rpad('1', int({rest}) + 1, '0')", "concat('card', length(d), substr(d, 1, 1))"), "f", f"concat(substr(d, 1, 1), lpad(cast(f.l AS string), int({half}), '0'), lpad(cast(f.r AS string), int({rest}), '0'))")
        check = f"cast(pmod(10 - ({self.luhn('e', '_t.odd')}), 10) AS string)"
        digits = lambda i, j: f"array_join(slice(g, int({i} + 1), int({j} - {i})), '')"
        made = let(digits("i", "e[i]"), "d", let(body, "e", f"concat(e, {check})"))
        # Before each group: how many digits, and the Luhn sums of all groups so far in a stretch that ends after an even or an odd number of digits.
        own = f"struct({{s}}.b + length({{v}}) AS b, if(length({{v}}) > 19, 0, {self.luhn('{v}')}) AS whole, if(length({{v}}) > 18, 0, {self.luhn('{v}', '_t.odd')}) AS moved)"
        after = "struct(y.b AS b, {s}.even + if(y.b % 2 = 0, y.whole, y.moved) AS even, {s}.odd + if(y.b % 2 = 1, y.whole, y.moved) AS odd)"
        sums = running("concat(g, array(''))", "struct(0 AS b, 0 AS even, 0 AS odd)", "struct<b: int, even: int, odd: int>", lambda s, v: s, lambda s, v: let(own.replace("{s}", s).replace("{v}", v), "y", after.replace("{s}", s)))
        # Ends of the stretches from group i that validate: of usual layouts, and the others from the longest.
        valid = "b[j].b - b[i].b BETWEEN 13 AND 19 AND if(b[j].b % 2 = 0, b[j].even - b[i].even, b[j].odd - b[i].odd) % 10 = 0"
        ends = f"filter(sequence(i + 1, least(i + {MOST_GROUPS}, size(g))), j -> {valid})"
        usual = "j = i + 1 OR array_join(transform(slice(g, int(i + 1), int(j - i)), t -> length(t)), ' ') IN ('4 4 4 4', '4 6 5', '4 6 4')"
        found = f"transform(sequence(0, size(g) - 1), i -> if(b[least(i + {MOST_GROUPS}, size(g))].b - b[i].b < 13, NULL, {let(ends, 'j', 'if(size(j) = 0, NULL, struct(i AS i, array_max(filter(j, j -> ' + usual + ')) AS u, reverse(j) AS o))')}))"
        # The end of the stretch taken from each group, or 0: first usual ones from the left, then others that meet none of them.
        taken = lambda end: running("v", "0", "int", lambda s, v: f"if({v} IS NULL, 0, {end(s, v)})", lambda s, v: f"if({v} IS NULL, {s}, greatest({s}, {end(s, v)}))")
        first = taken(lambda s, v: f"if({v}.u IS NULL OR {v}.i < {s}, 0, {v}.u)")
        meets = "exists(sequence(greatest(0, {v}.i - " + str(MOST_GROUPS) + "), j - 1), t -> u[t] > {v}.i)"
        other = taken(lambda s, v: f"if({v}.i < {s}, 0, coalesce(get(filter({v}.o, j -> NOT {meets.format(v=v)}), 0), 0))")
        both = "zip_with(u, o, (x, y) -> greatest(x, y))"
        covered = f"exists(sequence(greatest(0, i - {MOST_GROUPS}), i - 1), t -> e[t] > i)"
        laid = let(made, "m", "array_join(transform(sequence(i, e[i] - 1), t -> concat(if(t = 0, '', p[t - 1]), substr(m, b[t].b - b[i].b + 1, length(g[t])))), '')")
        pieces = f"array_join(transform(sequence(0, size(g) - 1), i -> CASE WHEN e[i] > 0 THEN {laid} WHEN i = 0 THEN g[i] WHEN {covered} THEN '' ELSE concat(p[i - 1], g[i]) END), '')"
        chosen = let(first, "u", let(other, "o", let(both, "e", pieces)))
        run = let(sums, "b", let(found, "v", f"if(exists(v, c -> c IS NOT NULL), {chosen}, x)"))
        twice = [sum(divmod(2 * d, 10)) for d in range(10)]
        even, odd = (f"array({', '.join(str(a[v // 10] + b[v % 10]) for v in range(100))})" for a, b in ((twice, range(10)), (range(10), twice)))
        return let(f"struct({even} AS even, {odd} AS odd)", "_t", let("split(x, '[ -]')", "g", let("regexp_extract_all(x, '[ -]', 0)", "p", run)))

    def phone(self) -> str:
        number = let(self.feistel("substr(d, -7, 3)", "substr(d, -4, 4)", "1000", "10000", "concat('phone', substr(d, 1, length(d) - 7))"), "f", "concat(substr(d, 1, length(d) - 7), lpad(cast(f.l AS string), 3, '0'), lpad(cast(f.r AS string), 4, '0'))")
        return f"if(length(d) BETWEEN 8 AND 15, {self.laid(number)}, x)"

    def ssn(self) -> str:
        area, group, serial = ("cast(substr(d, 1, 3) AS int)", "cast(substr(d, 4, 2) AS int)", "cast(substr(d, 6, 4) AS int)")
        valid = f"{area} BETWEEN 1 AND 899 AND {area} <> 666 AND {group} > 0 AND {serial} > 0"
        place = f"({area} - 1 - if({area} > 666, 1, 0)) * 99 + {group} - 1"
        made = "concat(lpad(cast(f.l div 99 + 1 + if(f.l div 99 + 1 >= 666, 1, 0) AS string), 3, '0'), lpad(cast(f.l % 99 + 1 AS string), 2, '0'), lpad(cast(f.r + 1 AS string), 4, '0'))"
        return f"if({valid}, {self.laid(let(self.feistel(place, f'{serial} - 1', str(898 * 99), '9999', "'ssn'"), 'f', made))}, x)"

    @staticmethod
    def walk(first: str, step: Callable[[str], str], able: Callable[[str], str]) -> str:
        """The first of step(first), step(step(first)), ... that is able."""
        further = f"aggregate(sequence(1, {WALK}), y, (v, turn) -> if({able('v')}, v, {step('v')}))"
        return let(step(first), "y", f"if({able('y')}, y, {further})")

    def ip(self) -> str:
        """Either without leading zeros or, with one at least, three digits to each part."""
        padded = f"concat_ws('.', {', '.join(f'lpad(cast({part} AS string), 3, chr(48))' for part in ('f.l div 256', 'f.l % 256', 'f.r div 256', 'f.r % 256'))})"
        plain = "concat_ws('.', f.l div 256, f.l % 256, f.r div 256, f.r % 256)"
        step = lambda v: self.feistel(f"{v}.l", f"{v}.r", "65536", "65536", "'ip'")
        place = "struct(cast(o[0] * 256 + o[1] AS bigint) AS l, cast(o[2] * 256 + o[3] AS bigint) AS r)"
        small = lambda v: f"least({v}.l div 256, {v}.l % 256, {v}.r div 256, {v}.r % 256) < 100"
        zeros = r"x RLIKE '(^|\\.)0[0-9]'"
        whole = f"CASE WHEN NOT {zeros} THEN {let(step(place), 'f', plain)} WHEN length(x) = 15 THEN {let(self.walk(place, step, small), 'f', padded)} ELSE x END"
        return let("transform(split(x, '[.]'), p -> cast(p AS int))", "o", f"if(array_max(o) <= 255, {whole}, x)")

    def date(self) -> str:
        """Day first where a date without dashes allows it, else month first, which all have days from 13 on."""
        # The dates of a cycle of 400 years are permuted among themselves: 146097 days, 189 times 773.
        step = lambda v: let(self.feistel(f"{v} div 773", f"{v} % 773", "189", "773", "'date'"), "f", "f.l * 773 + f.r")
        to = lambda v: f"date_add({_EPOCH}, int(floor(t.days / {_CYCLE}) * {_CYCLE} + {v}))"
        able = lambda v: f"year({to(v)}) BETWEEN 1 AND 9999 AND (t.format <> 'MM/dd/yyyy' OR day({to(v)}) > 12)"
        permuted = f"date_format({to(self.walk(f'cast(pmod(t.days, {_CYCLE}) AS bigint)', step, able))}, t.format)"
        formats = "if(substr(x, 5, 1) = '-', array('yyyy-MM-dd'), if(substr(x, 3, 1) = '/', array('dd/MM/yyyy', 'MM/dd/yyyy'), array('dd.MM.yyyy')))"
        known = f"filter(transform({formats}, g -> struct(datediff(to_date(try_to_timestamp(x, g)), {_EPOCH}) AS days, g AS format)), t -> t.days IS NOT NULL)"
        return let(known, "k", f"if(size(k) = 0, x, {let('k[0]', 't', permuted)})")

    def email(self) -> str:
        domain = "split_part(x, '@', 2)"
        part = lambda v, n: f"substr(sha2(concat_ws('|', {self.key}, lower({v})), 256), 1, {n})"
        return f"concat('u', {part('x', 12)}, '@', {part(domain, 8)}, '.example')"

    def secret(self) -> str:
        return let(f"substr(repeat(sha2(concat_ws('|', {self.key}, lower(x)), 256), int(length(x) div 64 + 1)), 1, length(x))", "h", "if(x = upper(x), upper(h), h)")

    def pseudonym(self) -> str:
        """Of x, the match at q of m between the pieces p, by the pattern that it matched: a secret by the words before it, others by their form."""
        before = "right(concat(coalesce(get(m, q - 1), ''), p[q]), 24)"
        cases = [("x LIKE '%@%'", "email"), (f"x RLIKE '^[A-Za-z0-9_+/-]{{16,}}$' AND {before} RLIKE {_quoted(_SECRET + '$')}", "secret"), (r"x RLIKE '^\\d{1,3}(?:\\.\\d{1,3}){3}$'", "ip"), (r"x RLIKE '^(?:\\d{4}-\\d{2}-\\d{2}|\\d{2}[/.]\\d{2}[/.]\\d{4})$'", "date")]
        cases += [(r"x RLIKE '^\\d{3}-\\d{2}-\\d{4}$'", "ssn"), (r"x RLIKE '^(?:[+(]|\\d{3}-\\d{3}-\\d{4}$)'", "phone"), (r"x RLIKE '^\\d[\\d -]*$'", "card")]
        chosen = " ".join(f"WHEN {test} THEN {self.with_digits(kind)}" for test, kind in cases)
        # Hashes of e-mail addresses and secrets cannot be inverted.
        return f"CASE {chosen} ELSE {'x' if self.inverse else self.secret()} END"

    def with_digits(self, kind: str) -> str:
        if kind in ("email", "secret") and self.inverse:
            return "x"
        sql = getattr(self, kind)()
        return let("regexp_replace(x, '[^0-9]', '')", "d", sql) if kind in ("phone", "ssn") else sql


#: One pattern; the back-reference of dates counts its groups from 1, and no other pattern has any. Those of numbers all begin with one of a few characters.
_WORDS, _NUMBERS = ("email", "secret"), ("ip", "date", "ssn", "phone", "card")
_ANY = "|".join(f"(?:{PATTERNS[kind]})" for kind in _WORDS) + "|(?=[0-9+(])(?:" + "|".join(f"(?:{PATTERNS[kind]})" for kind in _NUMBERS) + ")"


def pseudonymised(text_col: str, key: str, inverse: bool = False) -> Column:
    """A struct (text, n_replaced) for one text."""
    text, pattern = f"`{text_col}`", _quoted(_ANY)
    replaced = f"transform(m, (x, q) -> {_Sql(key, inverse).pseudonym()})"
    joined = "array_join(zip_with(p, r, (a, b) -> concat(a, coalesce(b, ''))), '')"
    counted = "cast(size(filter(zip_with(m, r, (a, b) -> a <> b), c -> c)) AS bigint)"
    some = let(f"split({text}, {pattern}, -1)", "p", let(replaced, "r", f"named_struct('text', {joined}, 'n_replaced', {counted})"))
    return F.expr(let(f"coalesce(regexp_extract_all({text}, {pattern}, 0), array())", "m", f"if(size(m) = 0, named_struct('text', {text}, 'n_replaced', 0L), {some})"))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", inverse: bool = False) -> DataFrame:
    """docs with their texts pseudonymised; all columns stay."""
    with parsed_once(docs.sparkSession):
        return docs.withColumn(text_col, pseudonymised(text_col, key, inverse)["text"])


def session_key(spark: SparkSession) -> str:
    """The key that the session sets, for registered queries."""
    return spark.conf.get(KEY_SETTING, DEMO_KEY)


def report(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_replaced) per row of docs."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    with parsed_once(docs.sparkSession):
        return rows.select("doc_id", pseudonymised("text", key).alias("p")).select("doc_id", "p.text", "p.n_replaced")
