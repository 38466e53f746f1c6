"""Declaration mining over a source corpus (E1-E12), as a line-table job.

Canonically formatted Go source starts every top-level declaration in
column 0 and closes every multi-line block with ``}`` or ``)`` in column 0.
So block membership, nesting depth, the comment block above a line and the
spec a member line belongs to are running values over the lines of one
file (window functions partitioned by ``(repo, path)``, ordered by line).
Each file's lines meet in one task, as the file itself did in one row.

Structure is read from a masked copy of the text, of the same length, in which
comments are blank and the insides of string, rune and raw literals are
underscores; so brackets, comment marks and declaration-like text in them
mislead nothing.

Limits (documented, not hidden): a block comment is no documentation; members
of anonymous structs nested inside a struct are part of their field's type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, memo_column, upper_initial
from .diff import SYMBOL_KEYS

DECL_RE = r"^(func|type|const|var|import)\b"
#: An identifier: letters of any script, digits and underscores.
IDENT = r"[\p{L}_][\p{L}\p{Nd}_]*"
#: Type parameters behind a name (three levels of brackets).
TYPE_PARAMS = r"\[(?:[^\[\]]|\[(?:[^\[\]]|\[[^\[\]]*\])*\])*\]"
#: Comments, literals and the text between them.
TOKEN_RE = (
    r"(?s)//[^\n]*|/\*.*?(?:\*/|\z)|\"(?:[^\"\\\n]++|\\.)*+\"?|`[^`]*+`?|'(?:[^'\\\n]++|\\.)*+'?|[^/\"`']++|/"
)
#: Stands where a line comment starts in the masked text.
MARK = "\u0001"
#: Declarations of one line, in their order, below this many.
PER_LINE = 1_000_000
# Words that start a type, so ``chan int`` is not a name
# followed by a type.
TYPE_WORDS = ["chan", "func", "map", "struct", "interface"]

PARAM_T = "array<struct<name:string,type:string>>"
FIELD_T = "array<struct<name:string,type:string,doc:string>>"


# --- text helpers (column expressions) --------------------------------------------


def squeeze(c) -> Column:
    """Trim and collapse runs of white space to one space."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def mask(content) -> Column:
    """The text with comments blank (``MARK`` where a line comment starts) and
    the insides of literals as underscores; lines and columns stay."""

    def masked(t):
        return (
            F.when(t.startswith("//"), F.concat(F.lit(MARK), F.repeat(F.lit(" "), F.length(t) - 1)))
            .when(t.startswith("/*"), F.regexp_replace(t, r"[^\n]", " "))
            .when(
                t.rlike("^[\"`']"),
                F.concat(
                    F.substr(t, F.lit(1), F.lit(1)),
                    F.regexp_replace(F.substr(t, F.lit(2), F.greatest(F.length(t) - 2, F.lit(0))), r"[^\n]", "_"),
                    F.when(F.length(t) > 1, F.substr(t, F.length(t), F.lit(1))).otherwise(F.lit("")),
                ),
            )
            .otherwise(t)
        )

    return F.array_join(F.transform(F.regexp_extract_all(content, F.lit(TOKEN_RE), F.lit(0)), masked), "")


def _delta(code) -> Column:
    opens = F.length(code) - F.length(F.regexp_replace(code, r"[({\[]", ""))
    closes = F.length(code) - F.length(F.regexp_replace(code, r"[)}\]]", ""))
    return opens - closes


def top_groups(s) -> Column:
    """Split ``s`` at its depth-0 parentheses: ``struct(groups
    array<struct<pre, inner>>, tail)`` where ``pre`` is the text before each
    top-level ``(...)`` and ``inner`` its content."""
    # buf is null outside a group and the group's text inside one
    zero = F.struct(
        F.lit(0).alias("d"),
        F.lit(None).cast("string").alias("buf"),
        F.lit("").alias("pre"),
        F.array().cast("array<struct<pre:string,inner:string>>").alias("g"),
    )

    def step(acc, ch):
        d = acc["d"]
        opening = ch.isin("(", "[", "{")
        closing = ch.isin(")", "]", "}")
        start = (d == 0) & (ch == "(")
        end = (d == 1) & (ch == ")") & (acc["buf"].isNotNull())
        nd = F.when(opening, d + 1).when(closing, d - 1).otherwise(d)
        in_group = acc["buf"].isNotNull()
        return F.when(
            start,
            F.struct(F.lit(1).alias("d"), F.lit("").alias("buf"), acc["pre"].alias("pre"), acc["g"].alias("g")),
        ).when(
            end & in_group,
            F.struct(
                F.lit(0).alias("d"),
                F.lit(None).cast("string").alias("buf"),
                F.lit("").alias("pre"),
                F.concat(acc["g"], F.array(F.struct(acc["pre"].alias("pre"), acc["buf"].alias("inner")))).alias("g"),
            ),
        ).when(
            in_group,
            F.struct(nd.alias("d"), F.concat(acc["buf"], ch).alias("buf"), acc["pre"].alias("pre"), acc["g"].alias("g")),
        ).otherwise(
            F.struct(nd.alias("d"), acc["buf"].alias("buf"), F.concat(acc["pre"], ch).alias("pre"), acc["g"].alias("g"))
        )

    return F.aggregate(
        F.split(s, ""), zero, step, lambda acc: F.struct(acc["g"].alias("groups"), acc["pre"].alias("tail"))
    )


def split_top(s, sep: str = ",") -> Column:
    """Split at ``sep`` outside brackets; parts are trimmed; '' gives []."""
    zero = F.struct(F.lit(0).alias("d"), F.lit("").alias("cur"), F.array().cast("array<string>").alias("parts"))

    def step(acc, ch):
        d = acc["d"]
        nd = F.when(ch.isin("(", "[", "{"), d + 1).when(ch.isin(")", "]", "}"), d - 1).otherwise(d)
        cut = (d == 0) & (ch == sep)
        return F.when(
            cut, F.struct(d.alias("d"), F.lit("").alias("cur"), F.concat(acc["parts"], F.array(F.trim(acc["cur"]))).alias("parts"))
        ).otherwise(F.struct(nd.alias("d"), F.concat(acc["cur"], ch).alias("cur"), acc["parts"].alias("parts")))

    out = F.aggregate(F.split(s, ""), zero, step, lambda acc: F.concat(acc["parts"], F.array(F.trim(acc["cur"]))))
    return F.when(F.trim(s) == "", F.array().cast("array<string>")).otherwise(out)


def parse_params(list_text) -> Column:
    """A parameter or result list (without the parentheses) ->
    ``ARRAY<STRUCT<name, type>>``. ``a, b int`` gives two entries with one
    type; a list is named when some part is ``word type`` and ``word`` is not
    a type keyword (``chan int`` is one unnamed type)."""
    parts = split_top(list_text)
    kw = "|".join(TYPE_WORDS)
    named_re = rf"^(?!(?:{kw})\b)({IDENT})\s+(\S.*)$"

    def build(ps):
        named = F.exists(ps, lambda p: p.rlike(named_re))
        # back-fill types from the right: "a, b int" -> a int, b int
        rev = F.reverse(ps)
        zero = F.struct(F.lit("").alias("t"), F.array().cast(PARAM_T).alias("out"))

        def step(acc, p):
            has_type = p.rlike(named_re)
            t = F.when(has_type, F.regexp_extract(p, named_re, 2)).otherwise(acc["t"])
            n = F.when(has_type, F.regexp_extract(p, named_re, 1)).otherwise(p)
            return F.struct(t.alias("t"), F.concat(F.array(F.struct(n.alias("name"), squeeze(t).alias("type"))), acc["out"]).alias("out"))

        named_list = F.aggregate(rev, zero, step, lambda acc: acc["out"])
        unnamed = F.transform(ps, lambda p: F.struct(F.lit("").alias("name"), squeeze(p).alias("type")))
        return F.when(named, named_list).otherwise(unnamed)

    return let(parts, build)


def parse_func_header(header) -> Column:
    """E4/E5 on a one-line function header (``func ... {`` or an interface
    method line): ``struct(recv, recv_type, name, params, returns,
    signature)``."""

    def with_groups(tg):
        gs = tg["groups"]
        has_recv = F.trim(F.try_element_at(gs, F.lit(1))["pre"]) == "func"
        k = F.when(has_recv, 2).otherwise(1)
        named = F.try_element_at(gs, k)
        name = F.regexp_extract(named["pre"], rf"({IDENT})\s*(\[.*\])?\s*$", 1)
        recv_text = F.when(has_recv, F.try_element_at(gs, F.lit(1))["inner"]).otherwise(F.lit(""))
        # "s *T" or "*T": drop the receiver name, then one "*"
        recv_type = F.regexp_replace(squeeze(F.regexp_replace(recv_text, rf"^\s*{IDENT}\s+(?=\S)", "")), r"^\*", "")
        res_group = F.try_element_at(gs, k + 1)
        # what follows the last list, up to the body's brace (a brace after
        # ``interface`` or ``struct`` belongs to a type)
        after = F.coalesce(tg["tail"], F.lit(""))
        before_body = F.regexp_extract(after, r"^((?:(?:interface|struct)\s*\{[^{}]*\}|[^{])*)", 1)
        bare = squeeze(before_body)
        returns = F.when(res_group.isNotNull(), parse_params(res_group["inner"])).when(
            bare != "", F.array(F.struct(F.lit("").alias("name"), bare.alias("type")))
        ).otherwise(F.array().cast(PARAM_T))
        sig = squeeze(F.substr(header, F.lit(1), F.length(header) - F.length(after) + F.length(before_body)))
        return F.struct(
            recv_text.alias("recv_text"),
            recv_type.alias("recv"),
            name.alias("name"),
            parse_params(named["inner"]).alias("params"),
            returns.alias("returns"),
            sig.alias("signature"),
        )

    return let(top_groups(header), with_groups)


# --- the line table ----------------------------------------------------------------


def line_table(files: DataFrame) -> DataFrame:
    """C5 + per-line state: ``repo, path, line_no, code (masked), text (the
    line without its comment), kw, block (line of its declaration), block_kw,
    in_block, depth (before the line, inside its block), is_comment,
    prev_comment, island (first line of the run of comments that the line is
    in or behind), note (its comment)`` and, for the declaration so far,
    ``grouped, stop_before`` (a line before it that ends the header).

    The files are dealt out by ``(repo, path)``; everything that follows is
    grouped by at least these columns, so no line is dealt out again."""
    spark = files.sparkSession
    text = files.filter(F.col("content") != "").select("repo", "path", F.replace("content", F.lit("\r\n"), F.lit("\n")).alias("_t"))
    # by number: few bytes of text are much work, so partitions are not put together
    text = text.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "repo", "path")
    both = F.arrays_zip(F.split("_t", "\n", -1).alias("line"), F.split(mask(F.col("_t")), "\n", -1).alias("masked"))
    lines = text.select("repo", "path", F.posexplode(both).alias("_i", "_l")).select(
        "repo", "path", (F.col("_i") + 1).alias("line_no"), "_l.line", "_l.masked"
    )
    w = Window.partitionBy("repo", "path").orderBy("line_no")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)

    mark = F.instr("masked", MARK)
    def before_comment(c):
        return F.regexp_replace(F.when(mark > 0, F.substr(c, F.lit(1), mark - 1)).otherwise(F.col(c)), r"\s+$", "")

    code = before_comment("masked")
    note = F.regexp_replace(F.regexp_replace(F.substr("line", mark + 2), r"^\s", ""), r"\s+$", "")
    df = lines.select(
        "repo", "path", "line_no",
        code.alias("code"),
        before_comment("line").alias("text"),
        ((mark > 0) & (code == "")).alias("is_comment"),
        F.when(mark > 0, note).otherwise(F.lit("")).alias("note"),
        F.regexp_extract("masked", DECL_RE, 1).alias("kw"),
    )
    opens = F.col("code").rlike(r"[{(]$")
    closer = F.col("code").rlike(r"^[)}]") & ~F.col("code").rlike(r"\{$")
    is_decl = F.col("kw") != ""
    df = df.withColumn("ends_block", (is_decl & ~opens) | closer).withColumn("delta", _delta(F.col("code")))
    # a header ends at the first line that opens the body or ends the block
    stop = F.col("code").rlike(r"\{[^{}]*\}?\s*$") | F.col("ends_block")
    df = df.withColumns({
        "block": F.last(F.when(is_decl, F.col("line_no")), ignorenulls=True).over(upto),
        "block_kw": F.last(F.when(is_decl, F.col("kw")), ignorenulls=True).over(upto),
        "grouped": F.last(F.when(is_decl, F.col("code").rlike(r"^(type|const|var)\s*\($")), ignorenulls=True).over(upto),
        "stop_before": F.last(F.when(stop, F.col("line_no")), ignorenulls=True).over(before),
        "_end_before": F.last(F.when(F.col("ends_block"), F.col("line_no")), ignorenulls=True).over(before),
        "_cum": F.coalesce(F.sum("delta").over(before), F.lit(0)),
        "prev_comment": F.coalesce(F.lag("is_comment").over(w), F.lit(False)),
    })
    in_block = F.col("block").isNotNull() & (F.col("_end_before").isNull() | (F.col("_end_before") < F.col("block")))
    starts = F.col("is_comment") & ~F.col("prev_comment")
    return df.withColumns({
        "in_block": in_block,
        "depth": F.col("_cum") - F.last(F.when(is_decl, F.col("_cum")), ignorenulls=True).over(upto),
        "island": F.last(F.when(starts, F.col("line_no")), ignorenulls=True).over(upto),
    }).drop("_end_before", "_cum", "ends_block")


def _doc(own, trailing) -> Column:
    return F.when(own != "", own).when(trailing != "", F.concat(trailing, F.lit("\n"))).otherwise(F.lit(""))


# --- E1-E12 ------------------------------------------------------------------------


def _syntax_error() -> Column:
    """What keeps ``content`` from being read, else null."""

    def found(m):
        def count(c):
            return F.length(m) - F.length(F.replace(m, F.lit(c), F.lit("")))

        code = F.regexp_replace(m, rf"^[\s{MARK}]+", "")
        return F.when(~code.rlike(rf"^package\s+{IDENT}"), F.lit("expected 'package' clause")).when(
            (count("(") != count(")")) | (count("{") != count("}")) | (count("[") != count("]")), F.lit("unbalanced brackets")
        )

    return F.when(F.col("content") != "", let(mask(F.col("content")), found))


def extract_errors(files: DataFrame) -> DataFrame:
    """Non-empty files that do not start with a ``package`` clause (apart
    from comments) or whose brackets do not match cannot be parsed; they yield
    no symbols and one error row."""
    return files.select("repo", "path", _syntax_error().alias("error")).filter(F.col("error").isNotNull())


# What a line is to its declaration (fixed order: a unit's items sort by it).
HEADER, SPEC, MEMBER, GROUP = "header", "spec", "member", "group"


def _relevant_lines(lt: DataFrame) -> DataFrame:
    """The lines that declare something, with their documentation: ``repo,
    path, block, l`` where ``l`` has ``line_no, role, unit`` (the line that
    names what it belongs to), ``item`` (the first line of the member),
    ``block_kw, grouped, c`` (its text), ``comment``, and ``doc_above``."""
    w = Window.partitionBy("repo", "path").orderBy("line_no")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    says = F.col("in_block") & ~F.col("is_comment") & (F.trim("code") != "")
    # type and value specs: the line of an ungrouped declaration, or a depth-1
    # line of a grouped one
    alone = (F.col("kw") != "") & ~F.col("grouped")
    listed = F.col("grouped") & (F.col("depth") == 1) & (F.col("kw") == "")
    is_spec = F.col("block_kw").isin("type", "const", "var") & says & (alone | listed) & ~F.col("code").rlike(r"^[)}\]]")
    lt = lt.withColumn("is_spec", is_spec).withColumns({
        "spec_line": F.last(F.when(F.col("is_spec"), F.col("line_no")), ignorenulls=True).over(upto),
        "spec_depth": F.last(F.when(F.col("is_spec"), F.col("depth")), ignorenulls=True).over(upto),
    })
    # members of struct and interface specs, one level below the spec; the line
    # that closes the spec is none
    rel = F.col("depth") - F.col("spec_depth")
    is_member = says & ~F.col("is_spec") & (F.col("block_kw") == "type") & (rel >= 1) & (rel + F.col("delta") >= 1)
    is_header = (F.col("block_kw") == "func") & F.col("in_block") & (
        F.col("stop_before").isNull() | (F.col("stop_before") < F.col("block"))
    )
    role = (
        F.when(is_header, HEADER).when(F.col("is_spec"), SPEC).when(F.coalesce(is_member, F.lit(False)), MEMBER)
        .when((F.col("kw") != "") & F.col("grouped"), GROUP)
    )
    lt = lt.withColumn("role", role)
    # a member may span lines: a parameter list, a nested struct
    first = (F.col("role") == MEMBER) & (rel == 1) & ~F.col("code").rlike(r"^\s*[)}\]]")
    lt = lt.withColumn("item", F.last(F.when(first, F.col("line_no")), ignorenulls=True).over(upto))
    spec_text = F.when(F.col("kw") != "", F.regexp_replace("text", r"^(type|const|var)\s+", "")).otherwise(F.col("text"))
    line = F.struct(
        "line_no", "role",
        F.when(F.col("role").isin(HEADER, GROUP), F.col("block")).otherwise(F.col("spec_line")).alias("unit"),
        F.when(F.col("role") == MEMBER, F.col("item")).otherwise(F.lit(0)).alias("item"),
        "block", "block_kw", "grouped",
        F.when(F.col("role") == HEADER, F.trim("code")).when(F.col("role") == SPEC, squeeze(spec_text))
        .when(F.col("role") == MEMBER, squeeze(F.col("text"))).otherwise(F.lit("")).alias("c"),
        F.when(~F.col("is_comment"), F.col("note")).otherwise(F.lit("")).alias("comment"),
    )
    # a run of comments is put together once, with the line behind it
    lt = lt.filter(F.col("is_comment") | F.col("role").isNotNull())
    island = F.when(F.col("is_comment") | F.col("prev_comment"), F.col("island")).otherwise(F.col("line_no"))
    met = lt.groupBy("repo", "path", island.alias("_k")).agg(
        F.max(F.when(F.col("role").isNotNull() & ~F.col("is_comment"), line)).alias("l"),
        F.array_sort(F.collect_list(F.when(F.col("is_comment"), F.struct("line_no", "note")))).alias("_notes"),
    )
    text = F.concat(F.array_join(F.transform("_notes", lambda x: x["note"]), "\n"), F.lit("\n"))
    return met.filter(F.col("l").isNotNull()).select(
        "repo", "path", "l.*", F.when(F.size("_notes") > 0, text).otherwise(F.lit("")).alias("doc_above")
    )


def _members(items) -> Column:
    """``array<struct<m, mdoc>>``: the members among a spec's items, each in
    one line, and those of a body on the spec's own line (``spec_text``)."""

    def joined(acc, x):
        follows = acc.rlike(r"[({\[,;]$") | x["c"].rlike(r"^[)}\]]") | (acc == "")
        return F.concat(acc, F.when(acc == "", "").when(follows, " ").otherwise("; "), x["c"])

    def member(it):
        text = F.regexp_replace(F.regexp_replace(F.aggregate(it["parts"], F.lit(""), joined), r"\(\s+", "("), r",?\s*\)", ")")
        return F.struct(squeeze(text).alias("m"), _doc(it["parts"][0]["doc_above"], F.element_at(it["parts"], -1)["comment"]).alias("mdoc"))

    body_re = rf"^{IDENT}(?:{TYPE_PARAMS})?\s*(?:struct|interface)\s*\{{(.*)\}}$"
    inline = F.transform(
        F.filter(split_top(F.regexp_extract("spec_text", body_re, 1), ";"), lambda m: m != ""),
        lambda m: F.struct(squeeze(m).alias("m"), F.lit("").alias("mdoc")),
    )
    spread = F.transform(F.filter(items, lambda it: it["role"] == MEMBER), member)
    return F.when(F.col("spec_text").rlike(body_re), F.concat(spread, inline)).otherwise(spread)


_METHOD_RE = rf"^({IDENT})\("
_FIELD_RE = rf"^({IDENT}(?:\s*,\s*{IDENT})*)\s+([^`]+?)\s*(`.*`)?$"


def _fields_of(members) -> Column:
    """Exported fields; an embedded type is a field named by itself."""

    def fields(x):
        embedded = F.regexp_replace(x["m"], r"\s*`.*`$", "")
        names = F.split(F.regexp_extract(x["m"], _FIELD_RE, 1), r"\s*,\s*")
        named = F.transform(
            F.filter(names, lambda nm: upper_initial(nm)),
            lambda nm: F.struct(nm.alias("name"), F.regexp_extract(x["m"], _FIELD_RE, 2).alias("type"), x["mdoc"].alias("doc")),
        )
        own = F.array(F.struct(embedded.alias("name"), embedded.alias("type"), x["mdoc"].alias("doc")))
        return F.when(x["m"].rlike(_FIELD_RE), named).otherwise(own)

    return F.flatten(F.transform(F.filter(members, lambda x: ~x["m"].rlike(_METHOD_RE)), fields))


def _methods_of(members) -> Column:
    """An interface's methods with their types."""
    return F.transform(
        F.filter(members, lambda x: x["m"].rlike(_METHOD_RE)),
        lambda x: F.struct(
            F.regexp_extract(x["m"], _METHOD_RE, 1).alias("name"),
            F.concat(F.lit("func"), F.regexp_replace(x["m"], rf"^{IDENT}", "")).alias("type"),
            x["mdoc"].alias("doc"),
        ),
    )


def mine_declarations(files: DataFrame, exported_only: bool = True) -> DataFrame:
    """``files(repo, path, content)`` -> a declaration table in the
    ``SYMBOLS`` schema (plus ``exported``). Files that fail E12 give nothing.

    One pass: the files are dealt out once, a line's state comes from windows
    over its file, and the relevant lines are put together by member and then
    by what they declare, without another exchange."""
    # (repo, path) names one file, so dropping the E12 files is a row filter,
    # not an anti join that would shuffle every file's text
    lines = _relevant_lines(line_table(files.filter(_syntax_error().isNull())))
    unit = ["repo", "path", "unit"]
    items = lines.groupBy(*unit, "item", "role").agg(
        F.array_sort(F.collect_list(F.struct("line_no", "c", "doc_above", "comment"))).alias("parts"),
        *[F.max(c).alias(c) for c in ("block", "block_kw", "grouped")],
    )
    units = items.groupBy(*unit).agg(
        F.array_sort(F.collect_list(F.struct("item", "role", "parts"))).alias("items"),
        *[F.max(c).alias(c) for c in ("block", "block_kw", "grouped")],
    )
    head = F.filter("items", lambda it: it["role"] != MEMBER)[0]
    units = units.withColumn("role", head["role"]).withColumn("_p", head["parts"])
    whole = Window.partitionBy("repo", "path", "block")
    units = units.select(
        "repo", "path", F.col("unit").alias("line_no"), "block_kw", "grouped", "role", "items",
        F.array_join(F.transform("_p", lambda x: x["c"]), " ").alias("_h"),
        F.col("_p")[0]["c"].alias("spec_text"),
        F.col("_p")[0]["doc_above"].alias("doc_above"),
        _doc(F.col("_p")[0]["doc_above"], F.col("_p")[0]["comment"]).alias("own_doc"),
        F.max(F.when(F.col("role") == GROUP, F.col("_p")[0]["doc_above"])).over(whole).alias("block_doc"),
        "block",
    )

    # --- values
    val_re = rf"^({IDENT}(?:\s*,\s*{IDENT})*)\s*([^=]*?)\s*(=.*)?$"
    is_value = (F.col("role") == SPEC) & F.col("block_kw").isin("const", "var")
    units = units.withColumn("_names", F.when(is_value, F.split(F.regexp_extract("spec_text", val_re, 1), r"\s*,\s*")))
    units = units.withColumn("_shown", F.filter("_names", lambda nm: upper_initial(nm)))
    label = F.min_by(F.try_element_at("_shown", F.lit(1)), F.when(F.size("_shown") > 0, F.col("line_no"))).over(whole)
    in_group = F.col("grouped") & (F.sum(is_value.cast("int")).over(whole) > 1)
    units = units.withColumn("grp", F.when(in_group, F.coalesce(label, F.lit(""))).otherwise(F.lit(""))).filter(F.col("role") != GROUP)
    no_params, no_fields = F.array().cast(PARAM_T), F.array().cast(FIELD_T)

    def symbol(ordinal, name, kind, signature, doc, exported, **given) -> Column:
        empty = {"recv": F.lit(""), "params": no_params, "returns": no_params, "fields": no_fields, "methods": no_fields, "grp": F.lit("")}
        parts = {"ordinal": ordinal, "name": name, "kind": kind, "signature": signature, "doc": doc, **empty, "exported": exported, **given}
        return F.struct(*[v.alias(k) for k, v in parts.items()])

    at = F.col("line_no").cast("long") * PER_LINE
    vtype = F.trim(F.regexp_extract("spec_text", val_re, 2))
    values = F.transform(
        "_names",
        lambda nm, i: symbol(
            at + i, nm, F.col("block_kw"),
            F.when(vtype != "", F.concat_ws(" ", F.col("block_kw"), nm, vtype)).otherwise(F.concat_ws(" ", F.col("block_kw"), nm)),
            F.col("own_doc"), upper_initial(nm), grp=F.col("grp"),
        ),
    )

    # --- type specs (E8) with their members
    tname = F.regexp_extract("spec_text", rf"^({IDENT})", 1)
    trest = F.trim(F.regexp_replace("spec_text", rf"^{IDENT}(?:{TYPE_PARAMS})?\s*", ""))
    tkind = (
        F.when(trest.rlike(r"^struct\b"), "struct").when(trest.rlike(r"^interface\b"), "interface")
        .when(trest.startswith("="), "type alias").otherwise("type")
    )
    tdoc = F.when(F.col("own_doc") != "", F.col("own_doc")).when(F.col("grouped"), F.coalesce("block_doc", F.lit(""))).otherwise(F.lit(""))

    def type_symbol(ms):
        body = F.array_join(F.transform(ms, lambda x: x["m"]), "; ")
        return symbol(
            at, tname, tkind,
            F.when(tkind.isin("struct", "interface"), F.concat(F.lit("type "), tname, F.lit(" "), tkind, F.lit(" {"), body, F.lit("}")))
            .otherwise(F.concat(F.lit("type "), tname, F.lit(" "), F.regexp_replace(trest, r"\s*\{\s*\}?$", ""))),
            tdoc, upper_initial(tname),
            fields=F.when(tkind == "struct", _fields_of(ms)).otherwise(no_fields),
            methods=F.when(tkind == "interface", _methods_of(ms)).otherwise(no_fields),
        )

    # --- functions and methods (headers may span lines up to the body's brace)
    def func_symbol(f):
        has_recv = f["recv_text"] != ""
        return symbol(
            at, F.when(has_recv, F.concat(f["recv"], F.lit("."), f["name"])).otherwise(f["name"]),
            F.when(has_recv, F.lit("method")).otherwise(F.lit("func")), f["signature"], F.col("doc_above"), upper_initial(f["name"]),
            recv=F.when(has_recv, f["recv"]).otherwise(F.lit("")), params=f["params"], returns=f["returns"],
        )

    def found() -> Column:
        header = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("_h"), r"\(\s+", "("), r",?\s*\)", ")"), r"\s+", " ")
        return (
            F.when(F.col("block_kw") == "func", F.array(let(parse_func_header(header), func_symbol)))
            .when(F.col("block_kw") == "type", F.array(let(_members(F.col("items")), type_symbol)))
            .otherwise(values)
        )

    out = units.select("repo", "path", F.explode(memo_column("mined_symbols", found)).alias("s")).select("repo", "path", "s.*")
    if exported_only:
        out = out.filter("exported")
    return out.select(*[c for c in SYMBOL_KEYS[:2]], "ordinal", "name", "kind", "signature", "doc", "recv",
                      "params", "returns", "fields", "methods", "grp", "exported")
