"""Column functions over texts: stripping, tokens, weights, heights, addresses, templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glotmill import fixed


#: All Unicode white space.
SPACES = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Trim all Unicode white space, as opposed to trim(), which trims spaces."""
    return F.btrim(c, F.lit(SPACES))


def squeeze(c: Column) -> Column:
    """Stripped, with runs of white space as one space."""
    return F.regexp_replace(strip(c), r"(?U)\s+", " ")


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def protected_tokens(c: Column, variant: str = "shared") -> Column:
    """The literal values of a text that a translation must keep, in order; see fixed.TOKEN_PATTERNS."""
    return F.regexp_extract_all(c, F.lit("(?iuU)" + fixed.TOKEN_PATTERNS[variant]), F.lit(0))


def numbers(c: Column) -> Column:
    """Plain numbers of a text in order, with a decimal comma as a point."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit(".")))


def weight(c: Column) -> Column:
    """Display width: ASCII characters count one, others two."""
    return F.length(c) + F.length(F.regexp_replace(c, r"[\x00-\x7F]", ""))


def capacity(width: Column) -> Column:
    """Weighted characters that a column of the given width shows on one line."""
    return F.greatest(F.lit(6), F.floor(F.coalesce(width, F.lit(8.43)) * 1.15)).cast("int")


def wrapped_lines(text: Column, width: Column) -> Column:
    """Estimated display lines of a cell: words fill lines of capacity(width), too long words run over."""
    cap = capacity(width)
    over = lambda n: F.ceil(n / cap).cast("int")
    tail = lambda n: F.when(n % cap > 0, n % cap).otherwise(F.least(n, cap)).cast("int")

    def put(state: Column, word: Column) -> Column:
        n, used = weight(word), state["used"]
        fits = used + 1 + n <= cap
        return (
            F.when(used == 0, F.struct((state["lines"] + F.greatest(F.lit(0), over(n) - 1)).cast("int").alias("lines"), tail(n).alias("used")))
            .when(fits, F.struct(state["lines"].alias("lines"), (used + 1 + n).cast("int").alias("used")))
            .otherwise(F.struct((state["lines"] + F.greatest(F.lit(1), over(n))).cast("int").alias("lines"), tail(n).alias("used")))
        )

    def one(line: Column) -> Column:
        words = F.array_remove(F.split(strip(line), r"(?U)\s+"), "")
        start = F.struct(F.lit(1).alias("lines"), F.lit(0).alias("used"))
        return F.aggregate(words, start, put, lambda s: s["lines"])

    return F.aggregate(F.split(text, r"\r?\n"), F.lit(0), lambda total, line: (total + one(line)).cast("int"))


def row_height(lines: Column, cap: float = 409.5, current: Column | None = None) -> Column:
    """Points for so many lines, at most `cap`, at least the current height."""
    need = F.least(F.lit(cap), lines * 15.0 + 3)
    return need if current is None else F.greatest(current, need)


def column_number(letters: Column) -> Column:
    """A1 column letters to a number, A being 1."""
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0), lambda n, c: F.when(c == "", n).otherwise(n * 26 + F.ascii(c) - 64).cast("int"))


def column_letters(n: Column) -> Column:
    """The inverse of column_number() up to three letters."""
    digit = lambda k: F.char(65 + k)
    one, two = (n - 1) % 26, F.floor((n - 1 - 26) / 26) % 26
    three = F.floor((n - 1 - 26 - 676) / 676) % 26
    return F.concat(F.when(n > 702, digit(three)).otherwise(""), F.when(n > 26, digit(two)).otherwise(""), digit(one))


def cell(address: Column) -> Column:
    """STRUCT<col, row> of an A1 address, with or without $; null fields if it isn't one."""
    pattern = r"^\$?([A-Za-z]{1,3})\$?([0-9]+)$"
    ok = address.rlike(pattern)
    return F.struct(
        F.when(ok, column_number(F.regexp_extract(address, pattern, 1))).alias("col"),
        F.when(ok, F.regexp_extract(address, pattern, 2).cast("int")).alias("row"),
    )


def metric_exponents(c: Column) -> Column:
    """m2 and m3 as m² and m³ where they are the unit, or end the unit, of a quantity; codes that look alike stay."""
    number = r"\d+(?:[.,]\d+)?"
    for digit, sign in (("2", "²"), ("3", "³")):
        quantity = rf"(?<![\p{{L}}\p{{N}}_./-]){number}(?:\s*[-–~]\s*{number})?\s*(?:[A-Za-z%]{{1,4}}[23²³]?/)?(?:N|[kcmd])?m"
        c = F.regexp_replace(c, rf"({quantity}){digit}(?![\p{{L}}\p{{N}}_²³]|-[\p{{L}}\p{{N}}])", f"$1{sign}")
    return c


def wildcard_pattern(c: Column) -> Column:
    """A formula's literal with wildcards as a regular expression: * any, ? one, ~ takes the next literally."""
    quoted = F.regexp_replace(c, r"([\\.\[\]{}()+^$|])", r"\\$1")
    kept = F.regexp_replace(F.regexp_replace(F.regexp_replace(quoted, r"~\*", "\u0001"), r"~\?", "\u0002"), "~~", "\u0003")
    open_ = F.regexp_replace(F.regexp_replace(kept, r"\*", ".*"), r"\?", ".")
    back = F.regexp_replace(F.regexp_replace(open_, "\u0001", r"\\*"), "\u0002", r"\\?")
    return F.concat(F.lit("(?s)^"), F.regexp_replace(back, "\u0003", "~"), F.lit("$"))


def is_safe_dimension(c: Column) -> Column:
    return strip(c).rlike(fixed.SAFE_DIMENSION)


def is_safe_identifier(c: Column) -> Column:
    s = strip(c)
    return s.rlike(fixed.SAFE_LETTER) | s.isin(*fixed.SAFE_CODES) | s.rlike(fixed.SAFE_IDENTIFIER)


def parameter(c: Column) -> Column:
    """STRUCT<label, separator, suffix> of a text like `Power: 45 kW` whose suffix is technical, else null."""
    shape = fixed.PARAMETER
    suffix = F.regexp_extract(c, shape, 3)
    fits = c.rlike(shape) & suffix.rlike(fixed.PARAMETER_VALUE) & ~suffix.rlike(r"[\p{IsHan}\p{IsCyrillic}\p{IsArabic}]")
    return F.when(fits, F.struct(strip(F.regexp_extract(c, shape, 1)).alias("label"), F.regexp_extract(c, shape, 2).alias("separator"), suffix.alias("suffix")))


def render(template: Column, translation: Column) -> Column:
    """A parameter's translated label with its separator and suffix; the translation alone without a template."""
    return F.when(template.isNotNull(), F.concat(translation, template["separator"], template["suffix"])).otherwise(translation)


def boundaries(c: Column) -> Column:
    """The tabs and line ends of a text, in order."""
    return F.regexp_extract_all(c, F.lit(r"[\t\n]"), F.lit(0))


def sheet_name_error(c: Column) -> Column:
    """Why a worksheet name is invalid, or null."""
    return (
        F.when(F.length(c) < 1, "empty").when(F.length(c) > 31, "too long")
        .when(c.rlike(r"[\[\]:*?/\\]"), "forbidden character").when(c.rlike(r"^'|'$"), "apostrophe at an edge")
    )


def retention_error(decision: Column, reason: Column, code: Column) -> Column:
    """Why a decision to leave a picture's text unchanged is invalid, or null; other decisions need no reason."""
    keeps = decision.isin("skip_target", "skip_unclear", "retain", "reviewed")
    kept, unclear = code.isin(*fixed.RETAIN_CODES), code == fixed.UNREADABLE_CODE
    allowed = F.when(decision == "skip_unclear", unclear).when(decision.isin("retain", "reviewed"), kept | unclear).otherwise(kept)
    return F.when(keeps & is_blank(reason), "reason missing").when(keeps & ~F.coalesce(allowed, F.lit(False)), "reason code not allowed")


def fixed_label(c: Column) -> Column:
    """The translation of a fixed label, white space in runs and at the ends apart; else null."""
    labels = F.create_map(*[F.lit(x) for kv in fixed.LABELS.items() for x in kv])
    return F.try_element_at(labels, squeeze(c))


def autofill(c: Column) -> Column:
    """What needs no translator: dimensions before identifiers before fixed labels; the rest is pending."""
    return (
        F.when(is_safe_dimension(c), "dimension retained").when(is_safe_identifier(c), "identifier retained")
        .when(fixed_label(c).isNotNull(), "fixed label").otherwise("pending")
    )


def bgr(rgb: Column) -> Column:
    """A colour of six hex digits, red first, as the number that has blue in its highest byte."""
    part = lambda i: F.conv(F.substring(rgb, i, 2), 16, 10).cast("int")
    return F.when(rgb.rlike("^[0-9A-Fa-f]{6}$"), part(5) * 65536 + part(3) * 256 + part(1))


def trim_ends(c: Column) -> Column:
    """Without line ends and vertical tabs at the end, then stripped."""
    return strip(F.regexp_replace(c, r"[\r\n\x0B]+$", ""))


def placeholders(c: Column) -> Column:
    """The numbering placeholders (%1, %2, ...) of a text, sorted: a bag that a translation must keep."""
    return F.array_sort(F.regexp_extract_all(c, F.lit(r"%\d"), F.lit(0)))


def without_width_controls(c: Column) -> Column:
    """Without zero-width characters and joiners that only steer where East Asian text breaks."""
    return F.regexp_replace(c, "[\u200b\u200c\u200d\u2060\ufeff]", "")


def has_human_text(texts: Column, prompts: Column | None = None) -> Column:
    """Whether any of the texts (array) has a letter, apart from template prompts."""
    own = texts if prompts is None else F.array_except(texts, prompts)
    return F.exists(own, lambda t: t.rlike(r"\p{L}"))


def reads_external_data(part: Column, formula: Column) -> Column:
    """Whether a part or a formula draws on data outside the workbook."""
    return F.coalesce(part.rlike("(?i)^xl/(externalLinks|connections|queryTables|model)"), F.lit(False)) | F.coalesce(formula.rlike(r"\[[^\]]+\]|(?i)\b(RTD|WEBSERVICE|CUBE\w*)\("), F.lit(False))


def residuals(c: Column, language: Column) -> Column:
    """How many characters of a text don't belong to its language; known for English, where all but ASCII count."""
    return F.when(language == "en", F.regexp_count(c, F.lit(r"[^\x00-\x7F]"))).otherwise(0)


def same_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Whether a / b is c / d, by cross-multiplication."""
    return a * d == b * c
