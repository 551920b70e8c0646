"""E: the question-answering pipeline over a DataFrame of questions.

A recipe is a tuple of ``DataFrame -> DataFrame`` stages. Retrieval is a
join + ranked window (see ``vectors.topk_cosine``), context and prompt are
string expressions, completion is a pluggable function run in
``mapInPandas`` over de-duplicated prompts, parsing is pure expressions, and
execution submits one Spark job per *distinct* generated statement.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import string
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import WS, iso_timestamp, strip_ws
from tessera.session import materialize

# Context section headings, fallbacks and response messages.
NO_CONTEXT = "No relevant schema information found."
NO_CONTEXT_FOR_PROMPT = "No relevant context available."
ERR_NO_RESPONSE = "No response received from the language model"
ERR_NO_SQL = "Could not extract a valid SQL query from the response"
ERR_EXEC = "Failed to execute the SQL query"
ERR_READ_ONLY = "Refused: only a single read-only SELECT or WITH statement is executed"
NO_EXPLANATION = "No explanation provided"

DEFAULT_TEMPLATE = """You translate questions about a database into one SQL query.

${context}

Question: ${query}

Answer with a JSON object {"query": "<SQL>", "explanation": "<what it returns>"}.
Prefix every table with the schema "${schema}", use only the columns listed above,
join along the foreign keys, and add no comments or markdown."""


# ------------------------------------------------------------ E1, E26 -----

def understand(questions: DataFrame) -> DataFrame:
    """Pass-through query understanding."""
    return questions.withColumn("processed_query", F.col("original_query"))


# ------------------------------------------------------------ E7-E10 ------

def format_tables(tables: Column, include_descriptions: bool = True) -> Column:
    """tables = array<struct<name, primary_keys, description, columns>> in rank order."""
    def one(t):
        parts = [F.concat(F.lit("Table: "), t["name"]),
                 F.when(F.size(t["primary_keys"]) > 0,
                        F.concat(F.lit("Primary Keys: "), F.array_join(t["primary_keys"], ", ")))]
        if include_descriptions:
            parts.append(F.when(F.coalesce(t["description"], F.lit("")) != "",
                                F.concat(F.lit("Description: "), t["description"])))
        parts.append(F.concat(F.lit("Columns: "), F.array_join(t["columns"], ", ")))
        return F.concat_ws("\n", *parts)
    return F.array_join(F.transform(tables, one), "\n\n")


def format_columns(columns: Column, include_descriptions: bool = True) -> Column:
    """columns = array<struct<table, name, data_type, is_primary_key, is_foreign_key, nullable, description>>."""
    def one(c):
        flags = F.array_compact(F.array(F.when(c["is_primary_key"], F.lit("Primary Key")),
                                        F.when(c["is_foreign_key"], F.lit("Foreign Key")),
                                        F.when(c["nullable"], F.lit("Nullable"))))
        parts = [F.concat(F.lit("Column: "), c["table"], F.lit("."), c["name"]),
                 F.concat(F.lit("Type: "), c["data_type"]),
                 F.when(F.size(flags) > 0, F.concat(F.lit("Attributes: "), F.array_join(flags, ", ")))]
        if include_descriptions:
            parts.append(F.when(F.coalesce(c["description"], F.lit("")) != "",
                                F.concat(F.lit("Description: "), c["description"])))
        return F.concat_ws("\n", *parts)
    return F.array_join(F.transform(columns, one), "\n\n")


def format_queries(queries: Column, include: bool = True) -> Column:
    """queries = array<struct<question, sql_query, explanation>>."""
    if not include:
        return F.lit("")

    def one(q):
        return F.concat_ws("\n", F.concat(F.lit("Question: "), q["question"]),
                           F.concat(F.lit("SQL: "), q["sql_query"]),
                           F.when(F.coalesce(q["explanation"], F.lit("")) != "",
                                  F.concat(F.lit("Explanation: "), q["explanation"])))
    return F.array_join(F.transform(queries, one), "\n\n")


def assemble_context(tables: Column, columns: Column, queries: Column, max_tables: int = 5,
                     max_columns: int = 10, max_queries: int = 2, include_table_desc: bool = True,
                     include_column_desc: bool = True, include_queries: bool = True) -> Column:
    """First n of each rank-sorted list, headed sections joined by a blank line."""
    def cut(a, n):
        return F.slice(F.coalesce(a, F.array()), 1, n)
    t = format_tables(cut(tables, max_tables), include_table_desc)
    c = format_columns(cut(columns, max_columns), include_column_desc)
    q = format_queries(cut(queries, max_queries), include_queries)
    sections = F.concat_ws("\n\n",
                           F.when(F.coalesce(t, F.lit("")) != "", F.concat(F.lit("RELEVANT TABLES:\n"), t)),
                           F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit("RELEVANT COLUMNS:\n"), c)),
                           F.when(F.coalesce(q, F.lit("")) != "", F.concat(F.lit("SIMILAR QUERIES:\n"), q)))
    return F.coalesce(F.nullif(sections, F.lit("")), F.lit(NO_CONTEXT))


# ------------------------------------------------------------------ E11 ---

def template_parts(template: str, known: set[str]) -> list[tuple[str, str | None]]:
    """Split a ``string.Template`` once on the driver into (literal, placeholder) parts.

    ``$$`` becomes ``$``; unknown or malformed placeholders stay as written
    (safe_substitute semantics).
    """
    pat = string.Template.pattern
    out, pos, lit = [], 0, ""
    for m in pat.finditer(template):
        lit += template[pos:m.start()]
        name = m.group("named") or m.group("braced")
        if m.group("escaped") is not None:
            lit += "$"
        elif name in known:
            out.append((lit, name))
            lit = ""
        else:
            lit += m.group(0)
        pos = m.end()
    out.append((lit + template[pos:], None))
    return out


def build_prompt(template: str, values: dict[str, Column]) -> Column:
    """Substitute ``${name}`` with columns; inserted text is never re-scanned."""
    pieces = []
    for lit, name in template_parts(template, set(values)):
        if lit:
            pieces.append(F.lit(lit))
        if name is not None:
            pieces.append(F.coalesce(values[name].cast("string"), F.lit("")))
    return F.concat(*pieces) if pieces else F.lit("")


# ------------------------------------------------------------- C4/E12 ----

CompletionFn = Callable[[list[str]], list[str | None]]


def complete(df: DataFrame, prompt_col: str, out_col: str, fn: CompletionFn,
             attempts: int = 2, wait_s: tuple[float, float] = (4.0, 10.0), failed_col: str | None = None) -> DataFrame:
    """Batch completion: de-duplicate prompts, call ``fn`` per Arrow batch, null for a prompt that fails on its own.

    ``failed_col`` tells such a prompt from one that is answered with null.

    The client lives inside ``fn`` (opened once per Python worker); retries
    with exponential wait happen inside the task so one flaky call does not
    fail the stage; Spark task retry covers lost executors. Calls must be
    idempotent because a retried task calls again.
    """
    key = F.sha2(F.col(prompt_col), 256)  # prompts are long: rows meet on digests
    prompts = df.where(F.col(prompt_col).isNotNull()).groupBy(key.alias("_key")).agg(F.first(prompt_col).alias("_prompt"))

    def ask(texts):
        for i in range(attempts):
            try:
                res = list(fn(texts))
                if len(res) == len(texts):
                    return res
            except Exception:  # noqa: BLE001 - provider errors are data here
                pass
            if i + 1 < attempts:
                time.sleep(min(wait_s[1], wait_s[0] * (2 ** i)))
        return None

    def run(it):
        for pdf in it:
            texts = pdf["_prompt"].tolist()
            res = ask(texts)
            failed = [False] * len(texts)
            if res is None:  # find the prompts that fail: the others keep their answers
                each = [None] if len(texts) == 1 else [ask([t]) for t in texts]
                res, failed = [(r or [None])[0] for r in each], [r is None for r in each]
            yield pd.DataFrame({"_key": pdf["_key"], "_answer": res, "_failed": failed})

    answers = prompts.mapInPandas(run, "_key string, _answer string, _failed boolean")
    out = df.join(answers, key == answers["_key"], "left").drop("_key").withColumnRenamed("_answer", out_col)
    return out.drop("_failed") if failed_col is None else out.withColumn("_failed", F.coalesce("_failed", F.lit(False))).withColumnRenamed("_failed", failed_col)


# ------------------------------------------------------------ E13-E16 ----

# What counts as SQL in a model's answer (the first of these that is found).
FENCE_SQL = f"(?i)```sql{WS}*([\\s\\S]*?){WS}*```"
FENCE_ANY = f"```{WS}*([\\s\\S]*?){WS}*```"
BARE_SQL = "(?i)(?:SELECT|INSERT|UPDATE|DELETE)[\\s\\S]*?;"


def strip_fence(c: Column) -> Column:
    """Text inside a ```json fence, else inside the first plain fence, trimmed."""
    t = strip_ws(c)
    return (F.when(t.contains("```json"), strip_ws(F.split_part(F.split_part(t, F.lit("```json"), F.lit(2)),
                                                                  F.lit("```"), F.lit(1))))
            .when(t.contains("```"), strip_ws(F.split_part(t, F.lit("```"), F.lit(2))))
            .otherwise(t))


def _json_object(c: Column) -> tuple[Column, Column, Column]:
    """(whether the text is one JSON object, query, explanation).

    The text is wrapped in ``[...]``: it is one JSON object exactly when the
    wrapper parses, its element 0 is an OBJECT and there is no element 1.
    """
    w = F.try_parse_json(F.concat(F.lit("["), strip_fence(c), F.lit("]")))
    first = F.try_variant_get(w, "$[0]", "variant")
    is_obj = F.coalesce(F.schema_of_variant(first).startswith("OBJECT"), F.lit(False))
    single = F.try_variant_get(w, "$[1]", "variant").isNull()
    q = F.try_variant_get(w, "$[0].query", "string")
    e = F.try_variant_get(w, "$[0].explanation", "string")
    return is_obj & single, q, e


def parse_json_answer(c: Column) -> tuple[Column, Column, Column]:
    """Strict JSON object gate -> (ok, query, explanation)."""
    is_object, q, e = _json_object(c)
    return is_object & F.coalesce(q != "", F.lit(False)), q, e


def _regex_sql(c: Column) -> tuple[Column, Column]:
    """SQL by fence or keyword pattern, and the text before it as explanation."""
    def pick(pat, grouped):
        g0 = F.regexp_extract(c, f"({pat})", 1)
        sql = strip_ws(F.regexp_extract(c, pat, 1)) if grouped else strip_ws(g0)
        if grouped:
            sql = F.when(sql != "", sql).otherwise(strip_ws(g0))
        return c.rlike(pat), sql, g0
    cases = [pick(FENCE_SQL, True), pick(FENCE_ANY, True), pick(BARE_SQL, False)]
    sql = F.when(cases[0][0], cases[0][1]).when(cases[1][0], cases[1][1]).when(cases[2][0], cases[2][1])
    g0 = F.when(cases[0][0], cases[0][2]).when(cases[1][0], cases[1][2]).when(cases[2][0], cases[2][2])
    # the first occurrence of the matched text is where the leftmost match starts
    pos = F.instr(c, g0)
    before = strip_ws(F.when(pos > 1, F.substr(c, F.lit(1), pos - 1)).otherwise(F.lit("")))
    return sql, F.nullif(before, F.lit(""))


def parse_answer(df: DataFrame, answer_col: str = "llm_response") -> DataFrame:
    """Adds sql_query, explanation (null when absent) and parse_method."""
    c = F.col(answer_col)
    ok, q, e = parse_json_answer(c)
    rsql, rexp = _regex_sql(c)
    return df.select("*",
                     F.when(ok, q).otherwise(rsql).alias("sql_query"),
                     F.when(ok, e).otherwise(rexp).alias("explanation"),
                     F.when(ok, F.lit("json")).when(rsql.isNotNull(), F.lit("regex"))
                     .otherwise(F.lit("none")).alias("parse_method"))


def lenient_json(c: Column) -> Column:
    """Fence strip + parse; any JSON object is returned, with an empty query where it has none; text that is no
    object gives an empty query and an error explanation."""
    is_object, q, e = _json_object(c)
    return F.when(is_object, F.struct(F.coalesce(q, F.lit("")).alias("query"), e.alias("explanation"))).otherwise(
        F.struct(F.lit("").alias("query"), F.lit("Error during JSON parsing").alias("explanation")))


# ------------------------------------------------------------ E17-E21 ----

# Nodes of a parsed statement that only read. Whatever is not listed is refused, so a kind of statement that a
# later Spark version adds is refused until someone has looked at it.
READING_NODES = frozenset((
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Distinct Deduplicate Join LateralJoin SubqueryAlias OneRowRelation LocalRelation "
    "Union Intersect Except Generate Expand Window WithWindowDefinition Pivot Unpivot Sample PipeOperator RepartitionByExpression "
    "UnresolvedRelation UnresolvedWith UnresolvedHaving UnresolvedHint UnresolvedInlineTable UnresolvedSubqueryColumnAliases "
    "UnresolvedTableValuedFunction UnresolvedTVFAliases").split())
# functions of Spark itself that call code named in their arguments, and the expressions they become
CALLING = frozenset(("reflect", "try_reflect", "java_method"))
CALLING_NODES = frozenset(("CallMethodViaReflection", "ScalaUDF", "PythonUDF", "PythonUDAF", "UserDefinedPythonFunction"))
STATEMENTS_AT_ONCE = 4


def _each(seq):
    return (seq.apply(i) for i in range(seq.size()))


def _nodes(plan, stop: str = ""):
    """All nodes of a plan, those of subqueries and common table expressions too, but not what lies below nodes called ``stop``."""
    todo = [plan]
    while todo:
        node = todo.pop()
        yield node
        if node.getClass().getSimpleName() != stop:
            for below in (node.children(), node.innerChildren(), node.subqueries()):
                todo += _each(below)


def _expressions(node):
    todo = list(_each(node.expressions()))
    while todo:
        e = todo.pop()
        yield e
        todo += _each(e.children())


def _known_function(spark: SparkSession, parts: list[str], tables: bool = False) -> bool:
    """Whether a function name stands for one of Spark's own functions that runs nothing but itself."""
    if [p.lower() for p in parts[:-1]] not in ([], ["builtin"], ["system", "builtin"]) or parts[-1].lower() in CALLING:
        return False
    catalyst = spark._jvm.org.apache.spark.sql.catalyst
    registry = catalyst.analysis.TableFunctionRegistry if tables else catalyst.analysis.FunctionRegistry
    return registry.builtin().functionExists(catalyst.FunctionIdentifier(parts[-1].lower()))


def is_read_only(spark: SparkSession, sql: str) -> bool:
    """8.13 guard on the parsed statement: nodes that only read, and Spark's own functions.

    ``spark.sql`` runs commands at once, and some statements run while they are analysed, so nothing that fails here may
    reach it. Names are taken from the parsed expressions: quoting and comments make no difference, and text inside a literal is
    no call. Text that does not parse is not read-only.
    """
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception:  # noqa: BLE001 - not a statement
        return False
    for node in _nodes(plan):
        kind = node.getClass().getSimpleName()
        if kind not in READING_NODES:
            return False
        if kind == "UnresolvedTableValuedFunction" and not _known_function(spark, list(_each(node.name())), tables=True):
            return False
        for e in _expressions(node):
            named = e.getClass().getSimpleName()
            if named == "UnresolvedFunction" and not _known_function(spark, list(_each(e.nameParts()))):
                return False
            if named == "UnresolvedGenerator" and not _known_function(spark, [e.name().funcName()], tables=True):
                return False
    return True


def reading_session(spark: SparkSession) -> SparkSession:
    """A copy of the session: it sees the caller's views and tables, but what it defines stays in it, and paths are no tables."""
    child = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    child.conf.set("spark.sql.runSQLOnFiles", "false")
    return child


def _calls_code(df: DataFrame) -> bool:
    """Whether the analysed statement itself (not a view's definition) calls code outside Spark's own expressions."""
    return any(e.getClass().getSimpleName() in CALLING_NODES
               for node in _nodes(df._jdf.queryExecution().analyzed(), stop="View") if node.getClass().getSimpleName() != "View" for e in _expressions(node))


def _fresh(name: str, taken: list[str]) -> str:
    """``name``, or a longer one that no column has (Spark tells names apart without case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def _write_rows(res: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Write a statement's full result, its last column the row's position; returns it as written, and its number of rows."""
    names: list[str] = []
    for c in res.columns:  # a result may name two columns alike
        names.append(c if _fresh(c, names) == c else _fresh(f"{c}_{len(names) + 1}", names + res.columns))
    res = res.toDF(*names)
    at, seen = _fresh("_position", names), Observation()
    res = res.select(*[F.col(f"`{f.name}`").cast("string") if isinstance(f.dataType, T.NullType) else F.col(f"`{f.name}`") for f in res.schema.fields],
                     F.monotonically_increasing_id().alias(at))
    written = materialize(res.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return written, seen.get["n"]


def full_result(spark: SparkSession, path: str) -> DataFrame:
    """All rows of an executed statement, in its order."""
    rows = spark.read.parquet(path)
    return rows.orderBy(f"`{rows.columns[-1]}`").drop(rows.columns[-1])


def _run(spark: SparkSession, child: SparkSession, sql: str, preview_rows: int) -> tuple:
    """(refused, executed, rows, path, preview) of one statement."""
    if not is_read_only(spark, sql):
        return True, False, None, None, None
    try:
        res = child.sql(sql)
        if _calls_code(res):
            return True, False, None, None, None
        rows, n = _write_rows(res, f"result-{hashlib.sha1(sql.encode()).hexdigest()[:12]}")
        columns = [F.col(f"`{c}`") for c in rows.columns[:-1]]
        first = [r[0] for r in rows.orderBy(f"`{rows.columns[-1]}`").limit(preview_rows).select(F.to_json(F.struct(*columns))).collect()]
        return False, True, n, rows.inputFiles()[0].rpartition("/")[0], first
    except Exception:  # noqa: BLE001 - analysis and run-time errors are this statement's alone
        return False, False, None, None, None


def execute_distinct(spark: SparkSession, df: DataFrame, sql_col: str = "sql_query", preview_rows: int = 10,
                     at_once: int = STATEMENTS_AT_ONCE) -> DataFrame:
    """Run each distinct read-only statement once, as a job of its own, so that one that fails leaves the others alone.

    Adds ``refused`` (not read-only), ``executed``, ``row_count`` and ``result_path`` of the full result (see ``full_result``)
    and ``preview``, its first rows as JSON. Statements run in a session of their own, ``at_once`` at a time. The driver
    holds a bounded batch of statements (SQL text is parsed there) and a few preview rows each; results stay in the shared folder.
    """
    schema = "_stmt string, refused boolean, executed boolean, row_count bigint, result_path string, preview array<string>"
    key, child, done = F.sha2(F.col(sql_col), 256), reading_session(spark), []
    asked = df.where(F.col(sql_col).isNotNull() & (F.col(sql_col) != "")).groupBy(key.alias("key")).agg(F.first(sql_col).alias("sql"))
    statements = asked.toLocalIterator()
    with ThreadPoolExecutor(at_once) as pool:
        while batch := list(itertools.islice(statements, 64 * at_once)):
            done += [(r["key"], *out) for r, out in zip(batch, pool.map(lambda r: _run(spark, child, r["sql"], preview_rows), batch))]
    status = spark.createDataFrame(done, schema)
    return df.join(status, key == status["_stmt"], "left").drop("_stmt")


def assemble_response(df: DataFrame, execute: bool = True) -> DataFrame:
    """Success / error states per row."""
    resp = F.col("llm_response")
    no_resp = resp.isNull() | (resp == "")
    no_sql = F.col("sql_query").isNull() | (F.col("sql_query") == "")
    guarded = F.coalesce(F.col("refused"), F.lit(False)) if execute else F.lit(False)
    executed = F.coalesce(F.col("executed"), F.lit(False)) if execute else F.lit(True)
    error = (F.when(no_resp, F.lit(ERR_NO_RESPONSE)).when(no_sql, F.lit(ERR_NO_SQL))
             .when(F.lit(not execute), F.lit(None))
             .when(guarded, F.lit(ERR_READ_ONLY)).when(~executed, F.lit(ERR_EXEC)))
    success = F.coalesce(error.isNull(), F.lit(False))
    explanation = (F.when(no_resp, F.lit(None)).when(no_sql, resp)
                   .otherwise(F.coalesce(F.col("explanation"), F.lit(NO_EXPLANATION))))
    return df.select("*", success.alias("success"), error.alias("error"),
                     explanation.alias("response_explanation"),
                     F.when(no_resp | no_sql, F.lit(None)).otherwise(F.col("sql_query")).alias("query"),
                     F.when(success & F.lit(execute), F.col("preview")).alias("response_preview"))


def sanitize(df: DataFrame) -> DataFrame:
    """Schema-driven projection: dates/timestamps to ISO text, binary to a marker, recursive."""
    def conv(c: Column, dt: T.DataType) -> Column:
        if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
            return iso_timestamp(c)
        if isinstance(dt, T.DateType):
            return F.date_format(c, "yyyy-MM-dd")
        if isinstance(dt, T.BinaryType):
            return F.when(c.isNotNull(), F.lit("[binary data]"))
        if isinstance(dt, T.ArrayType):
            return F.transform(c, lambda x: conv(x, dt.elementType))
        if isinstance(dt, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[conv(c[f.name], f.dataType).alias(f.name) for f in dt.fields]))
        if isinstance(dt, T.MapType):
            return F.transform_values(c, lambda k, v: conv(v, dt.valueType))
        return c
    return df.select(*[conv(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


# Fixed value: rows of a legacy preview.
LEGACY_ROWS = 5


def legacy_response(executed: DataFrame) -> DataFrame:
    """E25 over executed statements (``preview_rows`` = LEGACY_ROWS): success, number and place of all results, preview, error.

    An empty result has an empty preview; a statement that failed or was refused has an error and nothing else.
    """
    ok = F.coalesce(F.col("executed"), F.lit(False))
    error = F.when(~ok, F.when(F.col("refused"), F.lit(ERR_READ_ONLY)).otherwise(F.lit(ERR_EXEC)))
    return executed.withColumns({"success": ok, "n_results": F.when(ok, F.col("row_count")), "preview": F.when(ok, F.col("preview")), "error": error})


def project_response(df: DataFrame) -> DataFrame:
    """The public response fields."""
    return df.select("question_id", "success", "query", F.col("response_explanation").alias("explanation"),
                     F.col("response_preview").alias("preview"), "error",
                     F.coalesce(F.col("exact_match"), F.lit(False)).alias("from_vector_store"),
                     F.col("original_query").alias("original_question"), "metadata")


def stage_metadata(**entries: Column) -> Column:
    """key/value trace of the stages as map<string,string>."""
    kv = []
    for k, v in entries.items():
        kv += [F.lit(k), v.cast("string")]
    return F.create_map(*kv)


def run_recipe(questions: DataFrame, stages: tuple[Callable[[DataFrame], DataFrame], ...], strict: bool = True) -> DataFrame:
    """Stages applied in order (``DataFrame.transform`` chain).

    Not ``strict``: a stage that raises gives failed responses for all questions (success false, the stage's error).
    """
    try:
        return reduce(lambda d, s: d.transform(s), stages, questions)
    except Exception as exc:
        if strict:
            raise
        return questions.select("*", F.lit(False).alias("success"), F.lit(f"{type(exc).__name__}: {str(exc).splitlines()[0]}").alias("error"))
