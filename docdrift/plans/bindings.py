"""Derive operator inputs from the driver's tables.

The driver's tables hold no source code, documents-with-paths or replies, so
old and new versions are derived from them with plain column expressions
(the same derivations are written in SQL in ``oracle.py``). Every row of the
base table feeds one side or both; nothing is sampled or capped. The residue
``key % 10`` decides what happens to a row between versions:

* 0 - only in the new version (added)
* 1 - only in the old version (removed)
* 2 - in both, with its attributes changed (modified)
* 3 - in both, under a new name (a rename candidate)
* other - unchanged
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from ..operators.diff import kind_label

PARAM_T = "array<struct<name:string,type:string>>"
FIELD_T = "array<struct<name:string,type:string,doc:string>>"


# Tables whose rows carry long texts, with the column to spread them by.
TEXT_TABLES = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """Read one driver table. With ``spread``, a text table is dealt out by its
    key so heavy per-row text work runs in parallel. Reads that only need keys
    and labels are not spread."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.repartition(TEXT_TABLES[name]) if spread and name in TEXT_TABLES else df


# --- generic keyed rows (part) ---------------------------------------------


def part_rows(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """Flat keyed rows ``scope, name, kind, ptype, psize, ordinal``."""
    p = table(spark, sf_dir, "part")
    r = F.col("p_partkey") % 10
    if side == "old":
        return p.filter(r != 0).select(
            F.col("p_brand").alias("scope"),
            F.concat(F.lit("Sym"), F.col("p_partkey")).alias("name"),
            (F.col("p_partkey") % 8).cast("int").alias("kind"),
            F.col("p_type").alias("ptype"),
            F.col("p_size").alias("psize"),
            F.col("p_partkey").alias("ordinal"),
        )
    return p.filter(r != 1).select(
        F.col("p_brand").alias("scope"),
        F.when(r == 3, F.concat(F.lit("New"), F.col("p_partkey")))
        .otherwise(F.concat(F.lit("Sym"), F.col("p_partkey")))
        .alias("name"),
        (F.col("p_partkey") % 8).cast("int").alias("kind"),
        F.col("p_type").alias("ptype"),
        F.when(r == 2, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("psize"),
        F.col("p_partkey").alias("ordinal"),
    )


def part_rows_with_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old rows plus a second copy of every row under a higher ordinal whose
    size is shifted by 100, so last-wins de-duplication has work to do."""
    old = part_rows(spark, sf_dir, "old")
    copy = old.select(
        "scope", "name", "kind", "ptype", (F.col("psize") + 100).alias("psize"),
        (F.col("ordinal") + 1_000_000_000).alias("ordinal"),
    )
    return old.unionByName(copy)


# --- declaration tables (part) ---------------------------------------------


def symbols(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """A declaration table in the ``SYMBOLS`` schema derived from ``part``.

    repo = p_type, path = p_brand + '.go', kind = label of p_partkey % 8.
    The attribute ``v`` (p_size, +1 on the new side of residue 2) feeds
    parameter names, result names, field names, method types and
    signatures, so every nested comparison has something to find.
    """
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    r = k % 10
    ko = (k % 8).cast("int")
    if side == "old":
        p = p.filter(r != 0)
        v = F.col("p_size").cast("string")
        name = F.concat(F.lit("Sym"), k)
        kind = kind_label(ko)
        recv_n = k % 3
    else:
        p = p.filter(r != 1)
        v = F.when(r == 2, F.col("p_size") + 1).otherwise(F.col("p_size")).cast("string")
        name = F.when(r == 3, F.concat(F.lit("New"), k)).otherwise(F.concat(F.lit("Sym"), k))
        kind = F.when((ko == 6) & (r == 2), F.lit("var")).otherwise(kind_label(ko))
        recv_n = (k + F.when(r == 2, 1).otherwise(0)) % 3
    recv = F.when(ko == 1, F.concat(F.lit("T"), recv_n.cast("string"))).otherwise(F.lit(""))

    def ps(*pairs):
        return F.array(*[F.struct(F.lit(a).alias("name") if isinstance(a, str) else a.alias("name"),
                                  F.lit(b).alias("type") if isinstance(b, str) else b.alias("type"))
                         for a, b in pairs])

    def fs(*pairs):
        return F.array(*[F.struct(F.lit(a).alias("name") if isinstance(a, str) else a.alias("name"),
                                  F.lit(b).alias("type") if isinstance(b, str) else b.alias("type"),
                                  F.lit("").alias("doc"))
                         for a, b in pairs])

    empty_p = F.array().cast(PARAM_T)
    empty_f = F.array().cast(FIELD_T)
    params = (
        F.when(ko == 0, ps((F.concat(F.lit("p"), v), "int")))
        .when(ko == 1, ps(("", "string")))
        .otherwise(empty_p)
    )
    returns = (
        F.when(ko == 0, ps(("", "error")))
        .when(ko == 1, ps((F.concat(F.lit("n"), v), "int")))
        .otherwise(empty_p)
    )
    fields = F.when(ko == 2, fs(("Size", "int"), (F.concat(F.lit("Tag"), v), "string"))).otherwise(empty_f)
    methods = F.when(
        ko == 3, fs(("Get", "func() int"), ("Len", F.concat(F.lit("func() ["), v, F.lit("]int"))))
    ).otherwise(empty_f)
    sig = (
        F.when(ko == 0, F.concat(F.lit("func "), name, F.lit("(p"), v, F.lit(" int) error")))
        .when(ko == 1, F.concat(F.lit("func ("), recv, F.lit(") "), name, F.lit("(string) (n"), v, F.lit(" int)")))
        .when(ko == 2, F.concat(F.lit("type "), name, F.lit(" struct{Size int; Tag"), v, F.lit(" string}")))
        .when(ko == 3, F.concat(F.lit("type "), name, F.lit(" interface{Get() int; Len() ["), v, F.lit("]int}")))
        .when(ko == 4, F.concat(F.lit("type "), name, F.lit(" = ["), v, F.lit("]byte")))
        .when(ko == 5, F.concat(F.lit("type "), name, F.lit(" ["), v, F.lit("]byte")))
        .when(kind == "const", F.concat(F.lit("const "), name))
        .otherwise(F.concat(F.lit("var "), name, F.lit(" ["), v, F.lit("]int")))
    )
    return p.select(
        F.col("p_type").alias("repo"),
        F.concat(F.col("p_brand"), F.lit(".go")).alias("path"),
        k.cast("int").alias("ordinal"),
        name.alias("name"),
        kind.alias("kind"),
        sig.alias("signature"),
        F.col("p_name").alias("doc"),
        recv.alias("recv"),
        params.alias("params"),
        returns.alias("returns"),
        fields.alias("fields"),
        methods.alias("methods"),
        F.lit("").alias("grp"),
    )


# --- code snapshots, documents and configuration (documents) -------------------


def _ext(doc_id):
    return F.when(doc_id % 6 == 5, F.lit(".txt")).when(doc_id % 6 == 4, F.lit("_test.go")).otherwise(F.lit(".go"))


def code_snapshot(spark: SparkSession, sf_dir: str, side: str, spread: bool = True) -> DataFrame:
    """Source files: one per document, repo = lang, path under
    ``pkg/<source>/``; content is the document text plus a final newline.
    The new version appends a line to residue-2 files."""
    d = table(spark, sf_dir, "documents", spread=spread)
    k = F.col("doc_id")
    r = k % 10
    path = F.concat(F.lit("pkg/"), F.col("source"), F.lit("/f"), k.cast("string"), _ext(k))
    if side == "old":
        d = d.filter(r != 0)
        content = F.concat(F.col("text"), F.lit("\n"))
        ref = "base"
    else:
        d = d.filter(r != 1)
        content = F.concat(F.when(r == 2, F.concat(F.col("text"), F.lit("\nextra line"))).otherwise(F.col("text")), F.lit("\n"))
        ref = "head"
    return d.select(
        F.col("lang").alias("repo"), F.lit(ref).alias("ref"), path.alias("path"), content.alias("content"),
        F.sha2(content, 256).alias("content_hash"),
    )


def docs_table(spark: SparkSession, sf_dir: str, spread: bool = True) -> DataFrame:
    """Documents: repo = lang, path ``docs/<source>/<doc_id>.md`` (``.txt``
    for doc_id % 9 = 0). ``spread=False`` for reads that only need keys or
    lengths and go straight into a keyed shuffle."""
    d = table(spark, sf_dir, "documents", spread=spread)
    k = F.col("doc_id")
    ext = F.when(k % 9 == 0, F.lit(".txt")).otherwise(F.lit(".md"))
    return d.select(
        F.col("lang").alias("repo"),
        F.concat(F.lit("docs/"), F.col("source"), F.lit("/"), k.cast("string"), ext).alias("path"),
        F.col("text").alias("content"),
    )


# The configured document roots of every repository (a
# directory, one with a trailing slash, one with a leading './', a file that
# does not exist) - the shape of a ``docs.paths`` setting.
DOC_ROOTS = ["docs/src1", "docs/src2/", "./docs/src3", "README.md"]
# Fixed value: the folder that holds all documents (keys that size the whole
# selection).
ALL_ROOTS = ["docs"]


def doc_roots(spark: SparkSession, sf_dir: str, roots: list[str] = DOC_ROOTS) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("lang").alias("repo")).distinct().select(
        "repo", F.explode(F.array(*[F.lit(x) for x in roots])).alias("root")
    )


def doc_excludes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excluded paths: those of the documents with doc_id % 13 = 0, as ``.md``
    (some of which do not exist)."""
    return table(spark, sf_dir, "documents").filter(F.col("doc_id") % 13 == 0).select(
        F.col("lang").alias("repo"),
        F.concat(F.lit("docs/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
    )


def mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mapping per document with doc_id % 3 = 0: code prefix
    ``pkg/<source>`` (so ``pkg/src1`` also covers ``pkg/src10``..), docs = its
    own ``.md`` path (which some ``.txt`` documents do not have) and the
    source's ``README.md`` (which does not exist)."""
    folder = F.concat(F.lit("docs/"), F.col("source"), F.lit("/"))
    return table(spark, sf_dir, "documents").filter(F.col("doc_id") % 3 == 0).select(
        F.col("lang").alias("repo"),
        F.col("doc_id").alias("mapping_id"),
        F.array(F.concat(folder, F.col("doc_id").cast("string"), F.lit(".md")), F.concat(folder, F.lit("README.md"))).alias("docs"),
        F.array(F.concat(F.lit("pkg/"), F.col("source"))).alias("code"),
    )


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative paths from page URLs, with ``..`` and ``/`` variants by
    page_id % 4."""
    p = table(spark, sf_dir, "pages")
    tail = F.regexp_extract("url", "^[a-z]+://[^/]+/(.*)$", 1)
    m = F.col("page_id") % 4
    path = (
        F.when(m == 0, tail)
        .when(m == 1, F.concat(F.lit("../"), tail))
        .when(m == 2, F.concat(F.lit("a/../"), tail))
        .otherwise(F.concat(F.lit("/x/../../"), tail))
    )
    return p.select("page_id", path.alias("path"))


# --- replies (documents) --------------------------------------------------------

EDIT_T = "struct<file:string,action:string,old_text:string,new_text:string>"


def _edit(file_, action, old, new):
    return F.struct(file_.alias("file"), F.lit(action).alias("action"), old.alias("old_text"), new.alias("new_text"))


def edit_list(path, text, doc_id):
    """The edits a reply carries for one document, in order: put the first
    word in brackets, insert a note after it, delete text
    that is absent, an unknown action, and (doc_id % 5 = 0) a delete of the
    last 60 % of the text, (doc_id % 4 = 1) an edit naming another file."""
    note = F.concat(F.lit("Note "), doc_id.cast("string"))
    cut = F.floor(F.length(text) * 0.4).cast("int") + 1

    def with_word(w):
        items = F.array(
            _edit(path, "replace", w, F.concat(F.lit("["), w, F.lit("]"))),
            _edit(path, "insert_after", F.concat(F.lit("["), w, F.lit("]")), note),
            _edit(path, "delete", F.concat(F.lit("absent text "), doc_id.cast("string")), F.lit("")),
            _edit(path, "rewrite", w, F.lit("x")),
            F.when(doc_id % 5 == 0, _edit(path, "delete", F.substr(text, cut), F.lit(""))),
            F.when(doc_id % 4 == 1, _edit(F.lit("other.md"), "replace", w, F.lit("y"))),
        )
        return F.filter(items, lambda x: x.isNotNull())

    return let(F.regexp_extract(text, r"^(\S+)", 1), with_word)


def reply_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reply body per document (repo = lang, path as in
    ``docs_table``), shaped by doc_id % 7: 0 plain, 1 fenced, 2 fenced
    without newline (undecodable), 3 truncated, 4 empty content, 5 no
    choices, 6 ``{"edits": null}`` with an extra key."""
    d = table(spark, sf_dir, "documents", spread=True)
    k = F.col("doc_id")
    path = F.concat(
        F.lit("docs/"), F.col("source"), F.lit("/"), k.cast("string"),
        F.when(k % 9 == 0, F.lit(".txt")).otherwise(F.lit(".md")),
    )
    m = k % 7
    content = let(
        F.to_json(F.struct(edit_list(path, F.col("text"), k).alias("edits"))),
        lambda edits_json: F.when(m == 1, F.concat(F.lit("```json\n"), edits_json, F.lit("\n```")))
        .when(m == 2, F.concat(F.lit("```"), edits_json, F.lit("```")))
        .when(m == 4, F.lit(""))
        .when(m == 6, F.lit(' {"edits": null, "reason": "none"} '))
        .otherwise(edits_json),
    )
    choice = F.struct(
        F.struct(F.lit("assistant").alias("role"), content.alias("content")).alias("message"),
        F.when(m == 3, F.lit("length")).otherwise(F.lit("stop")).alias("finish_reason"),
    )
    choices = F.when(m == 5, F.array().cast(f"array<{choice_type()}>")).otherwise(F.array(choice))
    ptok = (F.octet_length("text") / 4).cast("int")
    usage = F.struct(ptok.alias("prompt_tokens"), F.lit(50).alias("completion_tokens"), (ptok + 50).alias("total_tokens"))
    body = F.to_json(F.struct(choices.alias("choices"), usage.alias("usage")))
    return d.select(F.col("lang").alias("repo"), path.alias("path"), k.alias("doc_id"), body.alias("body"))


def choice_type() -> str:
    return "struct<message:struct<role:string,content:string>,finish_reason:string>"


# --- attempt log (events) and change summaries (documents) -----------------------

# The reply bodies of the attempt log, by event type.
ATTEMPT_BODIES = {
    "error": '{"error": {"message": "maximum context length exceeded", "type": "invalid_request_error", "code": "context_length"}}',
    "view": '{"choices": [{"message": {"role": "assistant", "content": "{}"}, "finish_reason": "stop"}]}',
    "click": '{"error": {"message": "slow down", "type": "rate", "code": "429"}}',
    "purchase": '{"choices": []}',
}


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An attempt log: four consecutive events form one request
    (attempt = event_id % 4); status by (user_id + event_id) % 7; the body
    by event type; a numeric Retry-After for clicks."""
    e = table(spark, sf_dir, "events")
    s = (F.col("user_id") + F.col("event_id")) % 7
    status = (
        F.when(s == 0, 200).when(s == 1, 429).when(s == 2, 500).when(s == 3, 400)
        .when(s == 4, 401).when(s == 5, 0).otherwise(503)
    )
    body = F.lit(None).cast("string")
    for et, b in ATTEMPT_BODIES.items():
        body = F.when(F.col("event_type") == et, F.lit(b)).otherwise(body)
    body = F.coalesce(body, F.concat(F.lit("upstream "), F.col("event_type"), F.lit(" "), F.col("props")))
    return e.select(
        F.concat(F.lit("q"), F.floor(F.col("event_id") / 4).cast("bigint").cast("string")).alias("request_id"),
        (F.col("event_id") % 4).cast("int").alias("attempt"),
        status.cast("int").alias("status"),
        F.when(F.col("event_type") == "click", F.floor("value").cast("int").cast("string")).otherwise(F.lit("soon")).alias("retry_after"),
        body.alias("body"),
    )


def change_summaries(changed: DataFrame) -> DataFrame:
    """Per repository, the changed source paths as ``<change> <path>`` lines
    in path order. One text per repository is the product itself (it goes
    into every request of that repository)."""
    line = F.concat(F.col("change"), F.lit(" "), F.col("path"))
    return changed.groupBy("repo").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", line.alias("l")))), lambda x: x["l"]), "\n").alias("summary")
    )


# --- generated source corpus (supplier) ----------------------------------------


def go_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One generated, gofmt-shaped Go file per supplier (repo = 'r' +
    nationkey % 5, path ``pkg/s<k>.go``): a function with a multi-line
    parameter list when k % 4 = 0, a struct with docs, embedded and
    multi-name fields, a method, a const group, an ungrouped var, an
    interface with an embedded interface, an alias, a type definition and
    a function with func-typed, channel and variadic parameters. Files with
    k % 10 = 7 lack the package clause (parse failure)."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey").cast("string")
    nk = F.col("s_nationkey").cast("string")

    def L(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    get_single = L("func Get", k, "(id int, name string) (*Supplier", k, ", error) {")
    get_multi = L("func Get", k, "(\n\tid, nation int,\n\tname string,\n) (*Supplier", k, ", error) {")
    lines = [
        L("// Package p", k, " holds supplier ", k, "."),
        F.when(F.col("s_suppkey") % 10 == 7, F.lit("// no package clause")).otherwise(L("package p", k)),
        F.lit(""),
        F.lit('import (\n\t"fmt"\n)'),
        F.lit(""),
        L("// Get", k, " returns supplier ", k, "."),
        F.lit("// It never fails."),
        F.when(F.col("s_suppkey") % 4 == 0, get_multi).otherwise(get_single),
        F.lit("\treturn nil, nil\n}"),
        F.lit(""),
        L("// Supplier", k, " is one supplier."),
        L("type Supplier", k, " struct {"),
        F.lit("\t// ID is the key.\n\tID   int\n\tName string // display name\n\thidden int\n\tNation\n\tA, B float64\n}"),
        F.lit(""),
        F.lit("// Balance returns the account balance."),
        L("func (s *Supplier", k, ") Balance() float64 {"),
        L("\treturn ", F.col("s_acctbal").cast("string"), "\n}"),
        F.lit(""),
        L("// Limits of supplier ", k, "."),
        F.lit("const ("),
        L("\t// MaxItems", k, " caps items."),
        L("\tMaxItems", k, " = ", nk),
        L("\tminItems", k, " = 1"),
        L("\tLabel", k, "    string = \"", F.col("s_name"), "\""),
        F.lit(")"),
        F.lit(""),
        L("var Default", k, " = Supplier", k, "{}"),
        F.lit(""),
        L("// Reader", k, " reads."),
        L("type Reader", k, " interface {"),
        F.lit("\tRead(p []byte) (n int, err error)\n\tfmt.Stringer\n}"),
        F.lit(""),
        L("type ID", k, " = int64"),
        F.lit(""),
        L("type Count", k, " int"),
        F.lit(""),
        L("func Apply", k, "(f func(int) error, ch chan int, opts ...string) (ok bool) {"),
        F.lit("\treturn true\n}"),
        F.lit(""),
        L("func helper", k, "() {}"),
        F.lit(""),
    ]
    return s.select(
        F.concat(F.lit("r"), (F.col("s_nationkey") % 5).cast("string")).alias("repo"),
        L("pkg/s", k, ".go").alias("path"),
        F.concat_ws("\n", *lines).alias("content"),
    )
