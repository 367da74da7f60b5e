"""Column expressions on log lines, tokens and templates. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WILDCARD = "<*>"
#: Tokens of an entry in parity with the reference, pinned tokens of a template, characters of a token's shape.
MAX_TOKENS, PINNED, SHAPE_CHARS = 1024, 14, 20
#: ASCII white space on which lines are split; a vertical tab is none.
BLANK = r"[ \t\n\f\r]"


def token_shape(token: Column) -> Column:
    """Letters to ``a``, digits to ``d``, runs of one class collapsed, of the first 20 characters."""
    t = F.substring(token, 1, SHAPE_CHARS)
    t = F.regexp_replace(F.regexp_replace(t, "[A-Za-z]+", "a"), "[0-9]+", "d")
    return F.regexp_replace(t, r"(?s)(.)\1+", "$1")


def is_indented(line: Column) -> Column:
    return F.coalesce(line.rlike(r"^[ \t]"), F.lit(False))


def line_fingerprint(line: Column) -> Column:
    """Shapes of a line's first two tokens joined by ``|``; empty for a blank or null line."""
    first = F.slice(F.filter(F.split(F.coalesce(line, F.lit("")), r"(?U)\s+", 4), lambda x: x != ""), 1, 2)
    return F.array_join(F.transform(first, token_shape), "|")


def tokenize(line: Column) -> Column:
    """Tokens between blanks outside of round and square brackets.

    Any opening bracket counts up, any closing one down; a blank splits at depth 0 and below, and the depth starts anew
    after a split. So an unclosed bracket takes the rest of the line. A null line gives null.
    """
    plain = F.filter(F.split(line, BLANK + "+"), lambda x: x != "")
    pieces = F.regexp_extract_all(line, F.lit(BLANK + r"|[^ \t\n\f\r]+"), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        def count(signs: str) -> Column:
            return F.length(x) - F.length(F.regexp_replace(x, signs, ""))

        blank = x.rlike("^" + BLANK + "$")
        split = blank & (acc["depth"] <= 0)
        done = F.when(split & (acc["now"] != ""), F.array_append(acc["done"], acc["now"])).otherwise(acc["done"])
        return F.struct(
            done.alias("done"),
            F.when(split, "").otherwise(F.concat(acc["now"], x)).alias("now"),
            F.when(split, 0).when(blank, acc["depth"]).otherwise(acc["depth"] + count(r"[(\[]") - count(r"[)\]]")).alias("depth"),
        )

    zero = F.struct(
        F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("depth")
    )
    nested = F.aggregate(
        pieces,
        zero,
        step,
        lambda acc: F.when(acc["now"] != "", F.array_append(acc["done"], acc["now"])).otherwise(acc["done"]),
    )
    # closed brackets without a blank or another bracket inside never change the splitting
    simple = line.rlike(r"^(?:[^()\[\]]|[(\[][^()\[\]\s]*[)\]])*+$")
    return F.when(simple, plain).otherwise(nested)


def entry_tokens(line: Column, continuation: Column, most: int | None = None) -> Column:
    """Tokens of an entry, ``\\n`` before those of each further line; of them the first ``most`` (off by default, parity
    with the reference is ``MAX_TOKENS``)."""
    more = F.flatten(F.transform(continuation, lambda c: F.concat(F.array(F.lit("\n")), tokenize(c))))
    tokens = F.concat(tokenize(line), more)
    return tokens if most is None else F.slice(tokens, 1, most)


def is_variable(token: Column) -> Column:
    """Paths, long names with two dashes, and tokens of which at least 30 % of the bytes are digits."""
    size = F.octet_length(token)
    dashes = F.length(token) - F.length(F.translate(token, "-", ""))
    digits = F.length(token) - F.length(F.translate(token, "0123456789", ""))
    return token.contains("/") | token.contains("\\") | ((dashes >= 2) & (size > 10)) | ((digits > 0) & (F.floor(digits * 100 / size) >= 30))


def mask(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(is_variable(t), WILDCARD).otherwise(t))


def render(tokens: Column) -> Column:
    """Template text: tokens joined by blanks, line breaks without blanks around them."""
    return F.aggregate(
        tokens,
        F.lit(""),
        lambda acc, t: F.when(
            (acc == "") | (t == "\n") | acc.endswith("\n"), F.concat(acc, t)
        ).otherwise(F.concat(acc, F.lit(" "), t)),
    )


def parse_template(template: Column) -> Column:
    """Tokens of a template text; the inverse of ``render``."""
    lines = F.split(template, "\n")
    return F.flatten(
        F.transform(lines, lambda x, i: F.when(i == 0, tokenize(x)).otherwise(F.concat(F.array(F.lit("\n")), tokenize(x))))
    )


def variables(template: Column, tokens: Column) -> Column:
    """Tokens of an entry where its template has a wildcard."""
    both = F.arrays_zip(template.alias("t"), tokens.alias("v"))
    return F.transform(F.filter(both, lambda z: z["t"] == WILDCARD), lambda z: z["v"])


def reconstruct(template: Column, values: Column) -> Column:
    """Template text with wildcards replaced by successive values; wildcards beyond them stay, values beyond drop."""
    parts = F.split(template, r"<\*>")
    last = F.size(parts) - 1
    return F.array_join(
        F.transform(
            parts,
            lambda p, i: F.when(i == last, p)
            .when(i < F.size(values), F.concat(p, F.get(values, i)))
            .otherwise(F.concat(p, F.lit(WILDCARD))),
        ),
        "",
    )


def similarity(a: Column, b: Column) -> Column:
    """Share of positions of two equally long templates that agree or hold a wildcard; 0 for different lengths or line
    breaks, 1 for two empty ones."""
    pairs = F.zip_with(
        a,
        b,
        lambda x, y: F.when((x == "\n") | (y == "\n"), F.when(x == y, 1).otherwise(-1_000_000))
        .when((x == y) | (x == WILDCARD) | (y == WILDCARD), 1)
        .otherwise(0),
    )
    total = F.aggregate(pairs, F.lit(0), lambda acc, x: acc + x)
    return F.when(F.size(a) != F.size(b), 0.0).when(F.size(a) == 0, 1.0).otherwise(F.greatest(total, F.lit(0)) / F.size(a))


def csv_cell(value: Column) -> Column:
    """Quoted only where the value holds a comma, a quote or a line end."""
    return F.when(
        value.rlike('[,"\\n\\r]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    ).otherwise(value)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]+$", 0)


def percent_change(before: Column, after: Column) -> Column:
    """Signed whole percent, halves to the even number; nothing for a ``before`` of 0."""
    return F.format_string("%+.0f%%", F.bround((after - before) * 100.0 / before, 0))


def group_name(path: Column) -> Column:
    """Name of the file group of a log file: the file name without dates, numbered suffixes and counters.

    Dates are taken out twice, as taking one out can join the halves of another. Falls back to the file name.
    """
    name = base_name(path)
    day = r"\d{4}[-_]\d{2}[-_]\d{2}"
    compact = r"(?:19\d\d|20\d\d|2100)(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])(?!\d)"
    bare = name
    for _ in range(2):
        bare = F.regexp_replace(F.regexp_replace(bare, day, ""), compact, "")
    bare = F.regexp_replace(bare, r"(?:\.\d+)+$", "")
    dotted = F.regexp_replace(F.regexp_replace(bare, r"[._-]+", "."), r"^\.|\.$", "")
    segments = F.transform(
        F.split(dotted, r"\."), lambda s: F.when(s.rlike(r"^\d*$"), s).otherwise(F.regexp_replace(s, r"\d+$", ""))
    )
    kept = F.filter(
        F.transform(
            segments, lambda s, i: F.when((i == 0) | (s != F.get(segments, i - 1)), s)
        ),
        lambda s: s.isNotNull(),
    )
    joined = F.array_join(kept, ".")
    return F.when(joined == "", name).otherwise(joined)
