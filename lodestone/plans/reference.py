"""Queries of the index: paths, text, snapshot, joins, graph, search, history. Each with its SQL."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import paths as P
from ..functions import text as T
from ..operators import graph as G
from ..operators import history as H
from ..operators import relations as R
from ..operators import search as S
from ..operators import snapshot as N
from ..session import clean, latest, table, written
from .core_problems import current_files, tidy
from .registry import Registry

REGISTRY = Registry()
query = REGISTRY.query


def _list(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


#: Views for the SQL side: tidy distinct rows, current rows.
FILES = r"""(select * exclude (n_) from (select trim(rel, E' \t') rel, lower(ext) ext, size, mtime_ms, lines, lower(nullif(trim(hash, E' \t'), '')) hash, kind, nullif(trim(lang, E' \t'), '') lang, nullif(trim(title, E' \t'), '') title, nullif(trim(summary, E' \t'), '') summary, row_number() over (partition by trim(rel, E' \t') order by seen_at desc) n_ from files) where n_ = 1)"""
NODES = r"""(select * exclude (n_) from (select trim(rel, E' \t') rel, file_kind, nullif(trim(module, E' \t'), '') module, symbols, deg_in, deg_out, case when isnan(pagerank) then null else pagerank end pagerank, row_number() over (partition by trim(rel, E' \t') order by built_at desc) n_ from file_nodes) where n_ = 1)"""
SYMS = r"(select distinct file, pos, nullif(trim(name, E' \t'), '') name, kind, line, end_line, nullif(trim(parent, E' \t'), '') parent, exported, nullif(trim(lang, E' \t'), '') lang from symbols where file is not null)"
IDS = r"(select distinct file, nullif(trim(ident, E' \t'), '') ident from idents where nullif(trim(ident, E' \t'), '') is not null and file is not null)"
EDGES = r"(select distinct src, dst, kind, weight, coalesce(dangling, false) dangling, nullif(trim(reason, E' \t'), '') reason, nullif(trim(confidence, E' \t'), '') confidence from edges where src is not null and dst is not null)"


def files(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files").select(clean("rel").alias("rel"), F.lower("ext").alias("ext"), "size", "mtime_ms", "lines", F.lower(clean("hash")).alias("hash"), "kind", clean("lang").alias("lang"), clean("title").alias("title"), clean("summary").alias("summary"), "seen_at")
    return latest(f.where("rel is not null"), "rel", "seen_at", ["ext", "size", "mtime_ms", "lines", "hash", "kind", "lang", "title", "summary"])


def nodes(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "file_nodes").select(clean("rel").alias("rel"), "file_kind", clean("module").alias("module"), "symbols", "deg_in", "deg_out", F.when(~F.isnan("pagerank"), F.col("pagerank")).alias("pagerank"), "built_at")
    return latest(f.where("rel is not null"), "rel", "built_at", ["file_kind", "module", "symbols", "deg_in", "deg_out", "pagerank"])


def symbols(spark: SparkSession, d: str, by_file: bool = False) -> DataFrame:
    """``by_file``: shuffled by file alone, so that what follows by file needs no second shuffle."""
    s = table(spark, d, "symbols").where("file is not null").select("file", "pos", clean("name").alias("name"), "kind", "line", "end_line", clean("parent").alias("parent"), "exported", clean("lang").alias("lang"))
    return (s.repartition("file") if by_file else s).distinct()


def idents(spark: SparkSession, d: str, by_file: bool = False) -> DataFrame:
    i = table(spark, d, "idents").select("file", clean("ident").alias("ident")).where("ident is not null and file is not null")
    return (i.repartition("file") if by_file else i).distinct()


def edges(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "edges").where("src is not null and dst is not null")
    return e.select("src", "dst", "kind", "weight", F.coalesce("dangling", F.lit(False)).alias("dangling"), clean("reason").alias("reason"), clean("confidence").alias("confidence")).distinct()


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null")


# paths

_EXT_CASE = "case ext " + " ".join(f"when '{e}' then '{lang}'" for e, lang in K.LANGUAGE_OF.items()) + " else 'other' end"
_BASE = "lower(regexp_extract(rel, '[^/]*$'))"


@query("ex2_language", f"select rel, {_EXT_CASE} lang from {FILES}")
def ex2_language(spark, d):
    return files(spark, d).select("rel", P.language(F.col("ext")).alias("lang"))


@query(
    "ex1_classify",
    f"""select rel, case when {_EXT_CASE} not in ({_list(K.NOT_CODE)}) then 'code'
        when ext in ({_list(K.DOC_EXTENSIONS)}) or regexp_matches({_BASE}, '{K.DOC_BASENAME}') or regexp_matches(rel, '{K.DOC_DIR}') then 'doc'
        when {_BASE} in ({_list(K.CONFIG_NAMES)}) or ext in ({_list(K.CONFIG_EXTENSIONS)}) then 'config' else 'other' end kind from {FILES}""",
)
def ex1_classify(spark, d):
    return files(spark, d).select("rel", P.classify(F.col("rel"), F.col("ext")).alias("kind"))


def _within(names: list[str]) -> str:
    return f"list_has_any(string_split(lower(rel), '/'), [{_list(names)}])"


@query(
    "ex3_role",
    f"""select rel, case when {_within(K.I18N_DIRS)} and ext in ({_list(K.I18N_EXTENSIONS)}) then 'i18n'
        when ext in ({_list(K.SCHEMA_EXTENSIONS)}) or starts_with({_BASE}, 'schema.') or {_BASE} = 'models.py' or {_within(K.SCHEMA_DIRS)} then 'schema'
        when contains(lower(rel), '.test.') or contains(lower(rel), '.spec.') or {_within(K.TEST_DIRS)} then 'test'
        when {_BASE} in ({_list(K.CONFIG_ROLE)}) or regexp_matches({_BASE}, '\\.config\\.(js|ts|mjs)$|^\\.eslintrc|^\\.prettierrc|^\\.env|^docker-compose') then 'config'
        when ext in ({_list(K.DOC_EXTENSIONS)}) then 'doc' when ext in ({_list(K.STYLE_ROLE)}) then 'style' when ext in ({_list(K.CODE_ROLE)}) then 'code'
        when ext in ({_list(K.ASSET_ROLE)}) then 'asset' when ext in ({_list(K.DATA_ROLE)}) then 'data' else 'other' end role from {FILES}""",
)
def ex3_role(spark, d):
    return files(spark, d).select("rel", P.role(F.col("rel"), F.col("ext")).alias("role"))


GLOBS = ["packages/**/*.js", "**/*.py", "libs/*/src/**", "!**/*.test.*", "!**/vendor/**"]


@query("ex5_glob_filter", f"select rel from {FILES} where (regexp_matches(rel, '^packages/(.*/)?[^/]*\\.js$') or regexp_matches(rel, '^(.*/)?[^/]*\\.py$') or regexp_matches(rel, '^libs/[^/]*/src/.*$')) and not regexp_matches(rel, '^(.*/)?[^/]*\\.test\\.[^/]*$') and not regexp_matches(rel, '^(.*/)?vendor/.*$')")
def ex5_glob_filter(spark, d):
    return files(spark, d).where(P.glob_filter(F.col("rel"), GLOBS)).select("rel")


_IS_TEST = "(" + " or ".join(f"regexp_matches({{0}}, '{p}')" for p in (K.TEST_DIR, K.TEST_FILE, *K.TEST_NAMES)) + ")"


@query("ex27_test_paths", f"select rel from {FILES} where {_IS_TEST.format('rel')}")
def ex27_test_paths(spark, d):
    return files(spark, d).where(P.is_test(F.col("rel"))).select("rel")


@query("ex28_tiers", f"select path, case when path = '(root)' then 0 when regexp_matches(path, '{K.TIER2_ANY}') or regexp_matches(path, '{K.TIER2_LEAF}') then 2 when regexp_matches(path, '{K.TIER0}') then 0 else -1 end::int tier from (select distinct case when contains(rel, '/') then regexp_extract(rel, '^(.*)/[^/]*$', 1) else '(root)' end path from {FILES})")
def ex28_tiers(spark, d):
    return files(spark, d).select(P.directory(F.col("rel")).alias("path")).distinct().select("path", F.coalesce(P.tier(F.col("path")), F.lit(-1)).alias("tier"))


@query("ex29_entrypoints", f"select rel, regexp_matches(rel, '{K.ENTRY_PATH}') entry_path, lower(string_split(regexp_extract(rel, '[^/]*$'), '.')[1]) in ({_list(K.ENTRY_STEMS)}) entry_stem from {FILES}")
def ex29_entrypoints(spark, d):
    return files(spark, d).select("rel", P.is_entry_path(F.col("rel")).alias("entry_path"), P.is_entry_stem(F.col("rel")).alias("entry_stem"))


@query("sc2_ignored_dirs", f"select rel from {FILES} where list_has_any(string_split(rel, '/')[:-2], [{_list(K.IGNORED_DIRS)}])")
def sc2_ignored_dirs(spark, d):
    return files(spark, d).where(P.in_ignored_dir(F.col("rel"))).select("rel")


MAX_BYTES = 20_000


@query("sc3_rejects", f"select why, count(*) files from (select case when size > {MAX_BYTES} then 'size' when {_BASE} in ({_list(K.LOCKFILES)}) then 'lockfile' when ext in ({_list(K.BINARY_EXTENSIONS)}) then 'binary' when regexp_matches({_BASE}, '\\.min\\.(js|css)$') then 'minified' else 'kept' end why from {FILES}) group by why")
def sc3_rejects(spark, d):
    return files(spark, d).select(F.coalesce(P.rejected(F.col("rel"), F.col("ext"), F.col("size"), MAX_BYTES), F.lit("kept")).alias("why")).groupBy("why").agg(F.count(F.lit(1)).alias("files"))


@query("a24_excluded_and_capped", f"select count_if(size > {MAX_BYTES})::bigint excluded, count_if(size <= {MAX_BYTES}) > 20000 capped from {FILES}")
def a24_excluded_and_capped(spark, d):
    return files(spark, d).agg(F.count_if(F.col("size") > MAX_BYTES).alias("excluded"), (F.count_if(F.col("size") <= MAX_BYTES) > K.MAX_FILES).alias("capped"))


IGNORE_FILE = """
*.test.*
!**/panels/*.test.*
/tools/*/src/jobs/
generated/
packages/core/src/[a-c]*/
"""


@query(
    "sc5_ignored",
    f"""with p as (select rel, list_transform(range(1, len(string_split(rel, '/'))), lambda n: array_to_string(string_split(rel, '/')[:n], '/')) dirs from {FILES})
    select rel from p where
      case when regexp_matches(rel, '^(.*/)?panels/[^/]*\\.test\\.[^/]*$') then false else regexp_matches(rel, '^(.*/)?[^/]*\\.test\\.[^/]*$') end
      or len(list_filter(dirs, lambda x: regexp_matches(x, '^tools/[^/]*/src/jobs$') or regexp_matches(x, '^(.*/)?generated$') or regexp_matches(x, '^packages/core/src/[a-c][^/]*$')
        or (regexp_matches(x, '^(.*/)?[^/]*\\.test\\.[^/]*$') and not regexp_matches(x, '^(.*/)?panels/[^/]*\\.test\\.[^/]*$')))) > 0""",
)
def sc5_ignored(spark, d):
    return files(spark, d).where(P.ignored(F.col("rel"), P.ignore_rules(IGNORE_FILE))).select("rel")


@query("j4_nearest_scope", f"""with f as (select rel, string_split(rel, '/') p from {FILES}), s as (select distinct array_to_string(p[:2], '/') scope from f where len(p) > 2 union select distinct array_to_string(p[:4], '/') from f where len(p) > 4)
    select rel, arg_max(scope, length(scope)) scope from (select rel, array_to_string(p[:n], '/') scope from (select rel, p, unnest(range(0, len(p))) n from f)) semi join s using (scope) group by rel""")
def j4_nearest_scope(spark, d):
    f = files(spark, d).select("rel")
    parts = F.split("rel", "/")
    cut = lambda n: f.where(F.size(parts) > n).select(F.array_join(F.slice(parts, 1, n), "/").alias("scope"))
    return R.nearest_scope(f, cut(2).unionByName(cut(4)))


@query("fn_paths", f"select rel, {_BASE} base, case when contains(rel, '/') then regexp_extract(rel, '^(.*)/[^/]*$', 1) else '(root)' end dir, len(string_split(rel, '/')) depth, lower(regexp_extract(regexp_extract(rel, '[^/]*$'), '[^.](\\.[^.]*)$', 1)) ext from {FILES}")
def fn_paths(spark, d):
    r = F.col("rel")
    return files(spark, d).select("rel", F.lower(P.base(r)).alias("base"), P.directory(r).alias("dir"), F.size(P.ancestors(r)).cast("bigint").alias("depth"), P.extension(r).alias("ext"))


# text


@query("sc7_line_count", r"select doc_id, case when text = '' then 0 else len(string_split(text, E'\n')) end::bigint lines from documents where text is not null")
def sc7_line_count(spark, d):
    return docs(spark, d).select("doc_id", T.line_count(F.col("text")).cast("bigint").alias("lines"))


@query("sc8_content_hash", "select doc_id, sha1(text) hash, substr(sha1(text), 1, 8) short from documents where text is not null")
def sc8_content_hash(spark, d):
    return docs(spark, d).select("doc_id", F.sha1("text").alias("hash"), T.short_hash(F.col("text")).alias("short"))


@query("a23_fingerprint", f"select count(*) n, cast(sum(cast('0x' || substr(sha1(rel || ':' || hash), 1, 15) as bigint)) as varchar) fingerprint from {FILES}")
def a23_fingerprint(spark, d):
    return N.fingerprint(files(spark, d).where("hash is not null"))


@query("a1_languages", f"select lang, count(*) files from {FILES} group by lang")
def a1_languages(spark, d):
    return files(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("files"))


#: Letters that Unicode calls compatible with a plain one, such as raised digits: SQL strips marks, but keeps these.
_COMPATIBLE = [(c, p) for c, p in zip(T.FROM, T.TO) if unicodedata.decomposition(c).startswith("<") and c > "\xa0"]
_FOLDED = "case when length({0}) = strlen({0}) then {0} else strip_accents(translate({0}, '" + "".join(c for c, _ in _COMPATIBLE) + "', '" + "".join(p for _, p in _COMPATIBLE) + "')) end"
_APART = "regexp_replace(regexp_replace(" + _FOLDED + ", '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')"
_SUBTOKENS = "list_distinct(list_filter([case when regexp_matches(trim({0}), '\\s') then '' else regexp_replace(lower(" + _FOLDED + "), '[^a-z0-9_]+', '', 'g') end] || list_transform(regexp_split_to_array(" + _APART + ", '[^A-Za-z0-9]+'), lambda t: lower(t)), lambda t: length(t) >= 2))"


@query("ex23_subtokens", f"select name, array_to_string(list_sort({_SUBTOKENS.format('name')}), ' ') parts from (select distinct name from {SYMS} where name is not null)")
def ex23_subtokens(spark, d):
    return symbols(spark, d).select("name").distinct().where("name is not null").select("name", F.array_join(F.array_sort(T.subtokens(F.col("name"))), " ").alias("parts"))


@query("ex26_distinctive", rf"select name from (select distinct name from {SYMS}) where length(name) >= 5 and regexp_matches(name, '[a-z][A-Z]|[A-Z]{{2}}|_|[0-9]')")
def ex26_distinctive(spark, d):
    return symbols(spark, d).select("name").distinct().where(T.distinctive(F.col("name")))


@query("ex24_keyword_weights", f"""select ident, (case when regexp_matches(ident, '[0-9]') then 3.0 else 0 end + case when regexp_matches(ident, '[A-Z]') and not regexp_matches(ident, '^[A-Z0-9]+$') then 2.0 else 0 end + case when contains(ident, '_') then 2.0 else 0 end + case when length(ident) >= 8 then 1.5 when length(ident) >= 5 then 0.5 else 0 end)::double weight
    from (select distinct ident from {IDS}) where lower(ident) not in ({_list(K.STOPWORDS)}) and length(ident) >= 2""")
def ex24_keyword_weights(spark, d):
    i = idents(spark, d).select("ident").distinct().where(~F.lower("ident").isin(K.STOPWORDS) & (F.length("ident") >= 2))
    return i.select("ident", T.keyword_weight(F.col("ident")).alias("weight"))


@query("ex25_slugs", r"select heading, substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(heading), '^https?://', ''), '^git@', ''), '\.git$', ''), '[^a-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 120) slug, case when length(heading) <= 12 then heading else substr(heading, 1, 12) || E'\n… [truncated ' || (length(heading) - 12) || ' chars]' end clipped from (select distinct heading from headings where heading is not null)")
def ex25_slugs(spark, d):
    h = table(spark, d, "headings").select("heading").where("heading is not null").distinct()
    return h.select("heading", T.slug(F.col("heading")).alias("slug"), T.clip(F.col("heading"), 12).alias("clipped"))


def _complexity_sql(x: str) -> str:
    """Branch words and signs by pattern; question marks that are ternaries by what stands at both sides of each."""
    p = f"string_split({x}, '?')"
    ternary = f"len(list_filter(range(1, len({p})), lambda i: ({p}[i] <> '' and right({p}[i], 1) <> ':' or {p}[i] = '' and i = 1) and ({p}[i + 1] <> '' and left({p}[i + 1], 1) not in ('.', ':') or {p}[i + 1] = '' and i + 1 = len({p}))))"
    return f"(1 + len(regexp_extract_all({x}, '{T.BRANCHES}')) + {ternary})::bigint"


@query("ex30_complexity", f"select doc_id, {_complexity_sql('text')} complexity from documents where text is not null")
def ex30_complexity(spark, d):
    return docs(spark, d).select("doc_id", T.complexity(F.col("text")).cast("bigint").alias("complexity"))


@query("ex31_body", r"select doc_id, array_to_string(string_split(text, E'\n')[3:5], E'\n') body from documents where text is not null")
def ex31_body(spark, d):
    return docs(spark, d).select("doc_id", T.body(F.col("text"), F.lit(3), F.lit(5)).alias("body"))


# snapshot


def _listing(spark, d):
    return files(spark, d).select("rel", "kind", "hash", "size", "mtime_ms")


def _stored(spark, d):
    s = table(spark, d, "snapshot").select(clean("rel").alias("rel"), F.lower(clean("hash")).alias("hash"), "size", "mtime_ms", "run_id", "attempt", "written_at").where("rel is not null")
    return latest(s.withColumn("at", F.struct("run_id", "attempt", "written_at", "size", "mtime_ms")), "rel", "at", ["hash", "size", "mtime_ms"])


_STATUS = f"""(select coalesce(f.rel, s.rel) rel, case when f.rel is null then 'deleted' when s.rel is null then 'new' when f.kind <> 'doc' and f.size = s.size and f.mtime_ms = s.mtime_ms then 'stat_hit' when f.hash = s.hash then 'hash_hit' else 'changed' end status
    from {FILES} f full outer join (select * from (select trim(rel, E' \\t') rel, lower(nullif(trim(hash, E' \\t'), '')) hash, size, mtime_ms, row_number() over (partition by trim(rel, E' \\t') order by run_id desc, attempt desc, written_at desc, size desc, mtime_ms desc) n from snapshot) where n = 1) s on f.rel = s.rel)"""


@query("sc11_status", f"select rel, status from {_STATUS}")
def sc11_status(spark, d):
    return N.status(_listing(spark, d), _stored(spark, d))


@query("sc12_flags", f"select bool_and(status in ('stat_hit', 'hash_hit')) content_unchanged, not bool_and(status = 'stat_hit') cache_dirty, count_if(status = 'deleted')::bigint deleted from {_STATUS}")
def sc12_flags(spark, d):
    return N.flags(N.status(_listing(spark, d), _stored(spark, d)))


# relations

_UNIQUE = rf"(select name, min(file) def_file from (select distinct name, file from {SYMS} where name is not null and coalesce(kind, '') not in ({_list(K.REFERENCE_KINDS)})) where length(name) >= 5 and regexp_matches(name, '[a-z][A-Z]|[A-Z]{{2}}|_|[0-9]') group by name having count(*) = 1)"


@query("a6_unique_defs", f"select name, def_file from {_UNIQUE}")
def a6_unique_defs(spark, d):
    return R.unique_defs(symbols(spark, d))


@query("sk3_symbol_refs", f"select distinct i.ident name, i.file from {IDS} i join {_UNIQUE} u on i.ident = u.name where i.file <> u.def_file")
def sk3_symbol_refs(spark, d):
    return R.symbol_refs(idents(spark, d), R.unique_defs(symbols(spark, d)))


@query("j24_use_edges", f"select i.file src, u.def_file dst, least(count(*), 5)::bigint weight from {IDS} i join {_UNIQUE} u on i.ident = u.name where i.file <> u.def_file and not exists (select 1 from {EDGES} e where e.kind in ('import', 'call') and e.src = i.file and e.dst = u.def_file) group by i.file, u.def_file")
def j24_use_edges(spark, d):
    covered = edges(spark, d).where(F.col("kind").isin("import", "call"))
    return R.use_edges(idents(spark, d), R.unique_defs(symbols(spark, d)), covered)


_TOKENS = f"(select file rel, unnest(regexp_split_to_array(signature, '[^A-Za-z0-9_]+')) tok from (select distinct * from symbols where file is not null and signature is not null) union all select file, ident from {IDS})"


@query("j25_mention_edges", f"select rel src, def_file dst, sum(n)::bigint weight from (select t.rel, t.tok, u.def_file, least(count(*), 5) n from {_TOKENS} t join {_UNIQUE} u on u.name = t.tok where t.rel <> u.def_file group by all) group by rel, def_file")
def j25_mention_edges(spark, d):
    """Headings, the only words of documents in the tables, name no symbol; signatures and identifiers stand for words."""
    lines = table(spark, d, "symbols").where("file is not null and signature is not null").distinct()
    words = lines.select(F.col("file").alias("rel"), F.explode(F.split("signature", "[^A-Za-z0-9_]+")).alias("token"))
    tokens = words.unionByName(idents(spark, d).select(F.col("file").alias("rel"), F.col("ident").alias("token")))
    return R.mention_edges(tokens, R.unique_defs(symbols(spark, d)))


_CALLS = f"(select i.file src, i.ident name, case when s.lang in ('typescript', 'javascript') then 'js' when s.lang in ('c', 'cpp') then 'c' else s.lang end family, 1 + length(i.ident) % 3 n from {IDS} i join {FILES} s on s.rel = i.file)"
_CANDIDATES = f"""(with d as (select distinct name, file, exported, case when lang in ('typescript', 'javascript') then 'js' when lang in ('c', 'cpp') then 'c' else lang end family from {SYMS} where name is not null and coalesce(kind, '') not in ({_list(K.REFERENCE_KINDS)})),
    c as (select k.src, k.name, k.family, k.n, x.dst, exists (select 1 from {EDGES} e where e.kind = 'import' and not e.dangling and e.src = k.src and e.dst = x.dst) imported from {_CALLS} k join (select distinct name, file dst, family from d where exported) x on k.name = x.name and k.family = x.family where k.src <> x.dst and not exists (select 1 from d where d.name = k.name and d.file = k.src))
    select * from (select *, max(imported::int) over (partition by src, name) any_ from c) where case when family = 'js' or any_ = 1 then imported else true end)"""
_NEAR = f"""(select *, len(list_filter(range(1, 1 + least(len(string_split(src, '/')), len(string_split(dst, '/')))), lambda i: string_split(src, '/')[:i] = string_split(dst, '/')[:i])) near from {_CANDIDATES})"""
_TARGET = f"(select * from (select *, count(*) over (partition by src, name) rivals from (select *, max(near) over (partition by src, name) best from {_NEAR}) where near = best) where rivals = 1)"


def calls(spark, d):
    f = files(spark, d).select(F.col("rel").alias("src"), R.family(F.col("lang")).alias("family"))
    return idents(spark, d).select(F.col("file").alias("src"), F.col("ident").alias("name"), (F.lit(1) + F.length("ident") % 3).alias("n")).join(f, "src")


def imports(spark, d):
    return edges(spark, d).where("kind = 'import' and not dangling").select("src", "dst").distinct()


@query("j19_call_candidates", f"select src, name, count(*) candidates, bool_or(imported) imported from {_CANDIDATES} group by src, name")
def j19_call_candidates(spark, d):
    """One row a call with the number of its candidates: pairs of all callers and definers of a name are never made."""
    return R.call_candidates(calls(spark, d), symbols(spark, d), imports(spark, d))


@query("j20_proximity_pick", f"select src, name, dst from {_TARGET}")
def j20_proximity_pick(spark, d):
    return R.nearest_target(calls(spark, d), symbols(spark, d), imports(spark, d)).select("src", "name", "dst")


@query("a4_call_edges", f"select src, dst, least(sum(n), 5)::bigint weight, case when max(imported::int) = 1 then 'extracted' else 'inferred' end confidence from {_TARGET} group by src, dst")
def a4_call_edges(spark, d):
    return R.call_edges(calls(spark, d), symbols(spark, d), imports(spark, d)).withColumn("weight", F.col("weight").cast("bigint"))


_OWN = f"(select distinct name, file from {SYMS} where name is not null and coalesce(kind, '') not in ({_list(K.REFERENCE_KINDS)}))"
_LOCAL = f"(select k.src, k.name, k.n, k.src dst, true imported from {_CALLS} k semi join {_OWN} o on k.name = o.name and k.src = o.file)"
_BOUND = f"(select src, name, n, dst, imported from {_TARGET} union all select * from {_LOCAL})"


def bound(spark, d, recall: bool = False):
    return R.bindings(calls(spark, d), symbols(spark, d), imports(spark, d), recall)


@query("j21_caller_index", f"select case when dst = min(dst) over (partition by name) then name else name || '@' || dst end key, name, dst def_file, callers, sites, first_caller from (select name, dst, count(*) callers, sum(n)::bigint sites, min(src) first_caller from {_BOUND} group by name, dst)")
def j21_caller_index(spark, d):
    return R.caller_index(bound(spark, d)).withColumn("sites", F.col("sites").cast("bigint"))


@query("j21_caller_recall", f"""with d as (select distinct name, file dst, case when lang in ('typescript', 'javascript') then 'js' when lang in ('c', 'cpp') then 'c' else lang end family from {SYMS} where exported and name is not null and coalesce(kind, '') not in ({_list(K.REFERENCE_KINDS)})),
    one as (select name, min(dst) dst from d where family = 'js' group by name having count(*) = 1)
    select src, name, dst, case when imported then 'corroborated' else 'unique-name' end confidence from {_BOUND}
    union all select k.src, k.name, one.dst, 'unique-name' from {_CALLS} k join one on one.name = k.name where k.family = 'js' and k.src <> one.dst
      and not exists (select 1 from {_OWN} o where o.name = k.name and o.file = k.src) and not exists (select 1 from {EDGES} e where e.kind = 'import' and not e.dangling and e.src = k.src and e.dst = one.dst)""")
def j21_caller_recall(spark, d):
    """What each call binds to when scripts may also bind a name that one file alone defines."""
    return bound(spark, d, recall=True).select("src", "name", "dst", "confidence")


_SITES = f"(select file, ident name, 1 + (length(ident) * 13) % 200 line from {IDS})"


@query("j23_enclosing", f"""select s.file, s.name, s.line::int line, arg_max(d.name, d.line::hugeint * 1000000000000000000 + (2147483647 - coalesce(d.end_line, 2147483647))::hugeint * 100000000 + d.pos) enclosing
    from {_SITES} s left join {SYMS} d on s.file = d.file and d.name is not null and coalesce(d.kind, '') not in ({_list(K.REFERENCE_KINDS)}) and d.line <= s.line and (d.end_line is null or s.line <= d.end_line) group by s.file, s.name, s.line""")
def j23_enclosing(spark, d):
    sites = idents(spark, d).select("file", F.col("ident").alias("name"), (F.lit(1) + (F.length("ident") * 13) % 200).alias("line"))
    return R.enclosing(sites, symbols(spark, d)).drop("enclosing_line")


@query("j22_raw_callers", f"""select s.name, s.file, s.line::int line, arg_max(d.name, d.line::hugeint * 1000000000000000000 + (2147483647 - coalesce(d.end_line, 2147483647))::hugeint * 100000000 + d.pos) enclosing, coalesce(max(d.line), -1)::int enclosing_line
    from {_SITES} s left join {SYMS} d on s.file = d.file and d.name is not null and coalesce(d.kind, '') not in ({_list(K.REFERENCE_KINDS)}) and d.line <= s.line and (d.end_line is null or s.line <= d.end_line) group by s.file, s.name, s.line""")
def j22_raw_callers(spark, d):
    """Every site of every name as it is written, bound to nothing, with the innermost symbol around it."""
    sites = idents(spark, d).select("file", F.col("ident").alias("name"), (F.lit(1) + (F.length("ident") * 13) % 200).alias("line"))
    return R.enclosing(sites, symbols(spark, d)).select("name", "file", "line", "enclosing", F.coalesce("enclosing_line", F.lit(-1)).alias("enclosing_line"))


@query("a3_edge_dedupe", f"select src, dst, kind, sum(weight)::bigint weight, bool_or(dangling) dangling, min(reason) reason, min(confidence) confidence from {EDGES} group by src, dst, kind")
def a3_edge_dedupe(spark, d):
    return R.dedupe_edges(edges(spark, d))


_ONE = f"(select src, dst, kind, sum(weight) weight, bool_or(dangling) dangling from {EDGES} group by src, dst, kind)"


@query("a5_degrees", f"select n.rel, coalesce(i.n, 0) deg_in, coalesce(o.n, 0) deg_out from (select distinct rel from {NODES}) n left join (select dst, count(*) n from {_ONE} where not dangling group by dst) i on n.rel = i.dst left join (select src, count(*) n from {_ONE} group by src) o on n.rel = o.src")
def a5_degrees(spark, d):
    return R.degrees(R.dedupe_edges(edges(spark, d)), nodes(spark, d))


@query("a22_dangling_ratio", f"select kind, round(avg(dangling::int), 4) ratio from {_ONE} group by kind")
def a22_dangling_ratio(spark, d):
    return R.dedupe_edges(edges(spark, d)).groupBy("kind").agg(F.round(F.avg(F.col("dangling").cast("int")), 4).alias("ratio"))


_RANK = "case kind " + " ".join(f"when '{k}' then {r}" for k, r in K.LIFT_RANK.items()) + " else 0 end"
LIFT_SQL = f"(select a.module src_module, b.module dst_module, sum(weight)::bigint weight, arg_max(kind, {_RANK} * 1000 + ascii(kind)) kind from {_ONE} e join {NODES} a on e.src = a.rel join {NODES} b on e.dst = b.rel where a.module <> b.module group by a.module, b.module)"


def module_edges(spark, d):
    of = nodes(spark, d).where("module is not null").select("rel", "module")
    return R.lifted(R.dedupe_edges(edges(spark, d)), of)


@query("j26_module_lift", f"select * from {LIFT_SQL}")
def j26_module_lift(spark, d):
    return module_edges(spark, d)


@query("g6_undirected", f"select least(src_module, dst_module) a, greatest(src_module, dst_module) b, sum(weight)::bigint weight from {LIFT_SQL} group by 1, 2")
def g6_undirected(spark, d):
    return R.undirected(module_edges(spark, d), "src_module", "dst_module", "weight")


@query("j27_tests_map", f"select distinct dst rel, src test from {EDGES} where kind in ('import', 'use', 'call') and not dangling and {_IS_TEST.format('src')} and not {_IS_TEST.format('dst')}")
def j27_tests_map(spark, d):
    return R.tests_map(edges(spark, d))


@query("j28_untested", f"""with covered as (select distinct dst rel from {EDGES} where kind in ('import', 'use', 'call') and not dangling and {_IS_TEST.format('src')} and not {_IS_TEST.format('dst')})
    select module, sum(symbols)::bigint symbols from {NODES} n where module is not null group by module having bool_or(file_kind = 'code' and not {_IS_TEST.format('rel')}) and sum(symbols) > 0 and not bool_or(rel in (select rel from covered))""")
def j28_untested(spark, d):
    n = nodes(spark, d).where("module is not null")
    return R.untested(n, R.tests_map(edges(spark, d)).select("rel"))


@query("j29_dead_code", f"""select distinct d.name, d.file, d.line, d.kind, case when r.name is null then 1 else 2 end::int tier from {SYMS} d left join (select distinct i.ident name from {IDS} i join {_UNIQUE} u on i.ident = u.name where i.file <> u.def_file) r on d.name = r.name
    where d.exported and d.name is not null and coalesce(d.kind, '') not in ({_list(K.REFERENCE_KINDS)}) and not {_IS_TEST.format('d.file')} and not regexp_matches(d.file, '{K.ENTRY_PATH}') and not exists (select 1 from {_BOUND} b where b.name = d.name and b.dst = d.file)""")
def j29_dead_code(spark, d):
    s = written(symbols(spark, d), "symbols")
    called = R.bindings(calls(spark, d), s, imports(spark, d)).select("name", F.col("dst").alias("file"))
    return R.dead_code(s, called, R.symbol_refs(idents(spark, d), R.unique_defs(s)))


@query("j32_orphans", f"select rel from {NODES} where file_kind = 'code' and rel not in (select src from {_ONE} where kind = 'import' union select dst from {_ONE} where kind = 'import' and not dangling) and lower(string_split(regexp_extract(rel, '[^/]*$'), '.')[1]) not in ({_list(K.ENTRY_STEMS)})")
def j32_orphans(spark, d):
    """Over imports alone, of all kinds of links no file of the tables is without one."""
    n = nodes(spark, d).select("rel", "file_kind")
    return R.orphans(n.join(R.degrees(R.dedupe_edges(edges(spark, d).where("kind = 'import'")), n), "rel"))


RULES = [
    {"name": "tools-stay-out", "from": ["packages/**"], "to": ["tools/**"]},
    {"name": "no-test-imports", "from": ["**/src/**"], "to": ["**/*.test.*"], "kinds": ["import"], "severity": "warn"},
]


@query("j31_forbidden", f"select * from (select 'tools-stay-out' rule, 'error' severity, src, dst, kind from {EDGES} where not dangling and starts_with(src, 'packages/') and starts_with(dst, 'tools/') union all select 'no-test-imports', 'warn', src, dst, kind from {EDGES} where not dangling and kind = 'import' and regexp_matches(src, '^(.*/)?src/') and regexp_matches(dst, '^(.*/)?[^/]*\\.test\\.[^/]*$')) group by all")
def j31_forbidden(spark, d):
    return R.forbidden(edges(spark, d), RULES).distinct()


@query("a21_rule_counts", f"""select severity, count(*) violations from (select 'error' severity, src, dst, kind from {EDGES} where not dangling and starts_with(src, 'packages/') and starts_with(dst, 'tools/') group by all
    union all select 'warn', src, dst, kind from {EDGES} where not dangling and kind = 'import' and regexp_matches(src, '^(.*/)?src/') and regexp_matches(dst, '^(.*/)?[^/]*\\.test\\.[^/]*$') group by all) group by severity""")
def a21_rule_counts(spark, d):
    return R.forbidden(edges(spark, d), RULES).distinct().groupBy("severity").agg(F.count(F.lit(1)).alias("violations"))


@query("j30_surprises", f"""with c as (select distinct module, ascii(module) % 7 community, case when contains(module, 'core') then 0 else 1 end tier from {NODES} where module is not null),
    e as (select l.*, a.community ca, b.community cb, b.tier from {LIFT_SQL} l join c a on l.src_module = a.module join c b on l.dst_module = b.module where a.community <> b.community),
    p as (select least(ca, cb) lo, greatest(ca, cb) hi, count(*) pair_edges from e group by 1, 2)
    select src_module, dst_module, kind, weight, pair_edges from e join p on lo = least(ca, cb) and hi = greatest(ca, cb) where kind in ('import', 'call', 'use') and tier <> 0 and pair_edges <= 40 order by pair_edges, src_module, dst_module limit 24""")
def j30_surprises(spark, d):
    of = nodes(spark, d).where("module is not null").select("module").distinct().select("module", (F.ascii("module") % 7).alias("community"), F.when(F.col("module").contains("core"), 0).otherwise(1).alias("tier"))
    return R.surprises(module_edges(spark, d), of, per_pair=40)


_DIR = "case when contains(rel, '/') then regexp_extract(rel, '^(.*)/[^/]*$', 1) else '(root)' end"


@query("a7_modules", f"""with m as (select {_DIR} path, count(*) members, sum(coalesce(symbols, 0))::bigint symbols, bool_and(file_kind in ('doc', 'config') or regexp_matches(regexp_extract(rel, '[^/]*$'), '{K.TEST_FILE}')) all_tail from {NODES} group by 1),
    s as (select *, case when path = '(root)' then 'root' else replace(substr(regexp_replace(regexp_replace(regexp_replace(lower(path), '\\.git$', ''), '[^a-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 120), '.', '-') end slug from m)
    select path, case when count(*) over (partition by slug) > 1 then slug || '-' || substr(sha1(path), 1, 8) else slug end slug, members, symbols, case when path = '(root)' then 0 when regexp_matches(path, '{K.TIER2_ANY}') or regexp_matches(path, '{K.TIER2_LEAF}') then 2 when regexp_matches(path, '{K.TIER0}') then 0 when all_tail then 2 else 1 end::int tier from s""")
def a7_modules(spark, d):
    return R.module_groups(nodes(spark, d))


@query("a8_module_summaries", f"""with f as (select rel, title, summary, {_DIR} path, regexp_matches(lower(regexp_extract(rel, '[^/]*$')), '^(readme|index)\\.(md|mdx)$') readme from {FILES})
    select path, coalesce(arg_min(summary, rel) filter (readme and summary is not null and rel = rd), arg_min(title, rel) filter (readme and title is not null and rel = rd), arg_max(summary, (length(summary), summary)) filter (summary is not null), count(*) || ' file(s) in ' || case when path = '(root)' then 'the repository root' else '`' || path || '/`' end || '.') summary
    from (select *, min(case when readme then rel end) over (partition by path) rd from f) group by path""")
def a8_module_summaries(spark, d):
    return R.module_summaries(files(spark, d))


@query("a10_module_symbols", f"select module, sum(symbols)::bigint symbols, count(*) files from {NODES} where module is not null group by module")
def a10_module_symbols(spark, d):
    return nodes(spark, d).where("module is not null").groupBy("module").agg(F.sum("symbols").alias("symbols"), F.count(F.lit(1)).alias("files"))


# graph algorithms


def _module_graph(spark, d):
    n = nodes(spark, d).where("module is not null").select(F.col("module").alias("id")).distinct()
    e = written(module_edges(spark, d).select(F.col("src_module").alias("src"), F.col("dst_module").alias("dst"), "weight", "kind"), "module-edges")
    return n, e


_PR_ROUNDS = 8


def _pagerank_sql() -> str:
    ctes = [
        f"nat as (select n_nationkey id from nation)",
        "ed as (select c_nationkey src, s_nationkey dst, count(*)::double w from orders join customer on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey where c_nationkey <> s_nationkey group by 1, 2)",
        "ou as (select src, sum(w) o from ed group by src)",
        "r0 as (select id, 1.0 / (select count(*) from nat) pr from nat)",
    ]
    for i in range(1, _PR_ROUNDS + 1):
        p = f"r{i - 1}"
        ctes.append(f"r{i} as (select nat.id, (1 - 0.85 + 0.85 * coalesce((select sum(pr) from {p} where id not in (select src from ou)), 0)) / (select count(*) from nat) + 0.85 * coalesce(g.x, 0) pr from nat left join (select dst, sum({p}.pr * ed.w / ou.o) x from ed join {p} on ed.src = {p}.id join ou on ou.src = ed.src group by dst) g on g.dst = nat.id)")
    return "with " + ", ".join(ctes) + f" select id, round(pr * (select count(*) from nat), 4) pagerank from r{_PR_ROUNDS}"


@query("g2_pagerank", _pagerank_sql())
def g2_pagerank(spark, d):
    """Customer nations to supplier nations, a fixed number of rounds, so that SQL can follow."""
    o, c, li, s = (table(spark, d, t) for t in ("orders", "customer", "lineitem", "supplier"))
    flow = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(s, li["l_suppkey"] == s["s_suppkey"])
    e = flow.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.count(F.lit(1)).alias("weight"))
    return G.pagerank(table(spark, d, "nation").select(F.col("n_nationkey").alias("id")), e, iterations=_PR_ROUNDS, stop=0.0).select("id", F.round("rank", 4).alias("pagerank"))


_MODULES = f"(select distinct module id from {NODES} where module is not null)"


@query("g4_module_pagerank", f"""with recursive nat as materialized (select id, count(*) over () total from {_MODULES}), ed as materialized (select src_module src, dst_module dst, weight::double w from {LIFT_SQL}),
    share as materialized (select src, dst, w / sum(w) over (partition by src) s from ed), loose as materialized (select id from nat where id not in (select src from ed)),
    pr as (select id, 1.0::double / total r, total, 0 turn from nat union all
      select nat.id, (0.15 + 0.85 * coalesce((select sum(r) from pr where id in (select id from loose)), 0)) / nat.total + 0.85 * coalesce(g.x, 0), nat.total, (select max(turn) from pr) + 1
      from nat left join (select dst, sum(pr.r * share.s) x from pr join share on pr.id = share.src group by dst) g on g.dst = nat.id where (select max(turn) from pr) < {K.ITERATIONS})
    select id, round(r * total, 4) pagerank from pr where turn = {K.ITERATIONS}""")
def g4_module_pagerank(spark, d):
    n, e = _module_graph(spark, d)
    return G.pagerank(n, e).select("id", F.round("rank", 4).alias("pagerank"))


@query("g3_betweenness")
def g3_betweenness(spark, d):
    """Of every module; the guard of the operator is off, above which none is computed."""
    n, e = _module_graph(spark, d)
    return G.betweenness(n, e, most=None)


_AREAS = "(select distinct split_part(src, '/', 1) || '/' || left(split_part(src, '/', 2), 1) a, split_part(dst, '/', 1) || '/' || left(split_part(dst, '/', 2), 1) b from (select distinct src, dst from edges where src is not null and dst is not null and not coalesce(dangling, false)))"


@query("g3_area_betweenness", f"""with recursive e as (select a, b from {_AREAS} where a <> b union select b, a from {_AREAS} where a <> b), n as (select a id from {_AREAS} union select b from {_AREAS}),
    reach as (select id s, id t, 0 d from n union select reach.s, e.b, d + 1 from reach join e on reach.t = e.a where d < 4), dist as (select s, t, min(d) d from reach group by s, t),
    step as (select s.s, s.t v, e.b w from dist s join e on s.t = e.a join dist t on t.s = s.s and t.t = e.b and t.d = s.d + 1), path as (select id s, id t from n union all select path.s, step.w from path join step on path.s = step.s and path.t = step.v),
    sigma as (select s, t, count(*) c from path group by s, t), total as (select count(*) k from n),
    score as (select x.t id, sum(a.c * b.c / z.c::double) x from dist x join sigma a on a.s = x.s and a.t = x.t join dist y on y.s = x.t join sigma b on b.s = y.s and b.t = y.t join dist w on w.s = x.s and w.t = y.t and w.d = x.d + y.d join sigma z on z.s = w.s and z.t = w.t where x.d > 0 and y.d > 0 group by x.t)
    select n.id, round(coalesce(x, 0) / 2 / ((k - 1) * (k - 2) / 2.0), 6) betweenness from n left join score using (id), total""")
def g3_area_betweenness(spark, d):
    """Of the areas (first folder and first letter of the second), few enough for SQL to count all shortest paths."""
    area = lambda c: F.concat_ws("/", F.split_part(c, F.lit("/"), F.lit(1)), F.substring(F.split_part(c, F.lit("/"), F.lit(2)), 1, 1))
    e = edges(spark, d).where("not dangling").select(area(F.col("src")).alias("src"), area(F.col("dst")).alias("dst")).distinct()
    return G.betweenness(e.select(F.col("src").alias("id")).union(e.select("dst")), e).select("id", "betweenness")


@query("g5_communities")
def g5_communities(spark, d):
    n, e = _module_graph(spark, d)
    return G.communities(n, e)


@query("g5_placed", f"select id, true placed from {_MODULES}")
def g5_placed(spark, d):
    """Whether each module is in one community and the communities are numbered without gaps."""
    c = written(g5_communities(spark, d), "communities")
    n = c.select("community").distinct().count()
    return c.groupBy("id").agg((F.count(F.lit(1)) == 1).alias("one"), F.min("community").alias("c")).select("id", (F.col("one") & F.col("c").between(0, n - 1)).alias("placed"))


def _import_modules(spark, d):
    return module_edges(spark, d).where("kind = 'import'").select(F.col("src_module").alias("src"), F.col("dst_module").alias("dst"))


@query("g12_import_cycles")
def g12_import_cycles(spark, d):
    """A shortest cycle through the least module of each set of modules that import each other."""
    return G.cycle_rows(_import_modules(spark, d)).select("least", "length", F.array_join("path", " > ").alias("path"))


@query("g12_cycle_members", f"""with recursive e as materialized (select distinct src_module a, dst_module b from {LIFT_SQL} where kind = 'import'), reach as (select a, b from e union select reach.a, e.b from reach join e on reach.b = e.a)
    select x.a module, min(y.a) least from reach x join reach y on x.a = y.b and x.b = y.a where exists (select 1 from reach z where z.a = x.a and z.b = x.a) group by x.a""")
def g12_cycle_members(spark, d):
    """Each module that lies on a cycle of imports with the least module that it reaches and that reaches it."""
    return G.strong_sets(_import_modules(spark, d)).select(F.col("id").alias("module"), "least")


@query("g15_topological_order", "select row_number() over (order by lvl, pkg) - 1 position, pkg from (values ('app', 3), ('base', 0), ('core', 1), ('data', 1), ('ui', 2), ('util', 0)) v(pkg, lvl)")
def g15_topological_order(spark, d):
    needs = {"app": {"ui", "data"}, "ui": {"core"}, "core": {"base"}, "data": {"base", "util"}}
    order = G.topological(["app", "base", "core", "data", "ui", "util"], needs)
    return spark.createDataFrame(list(enumerate(order)), "position bigint, pkg string")


# search

QUESTION = "iron bell tower clockmakr"
_WORDS = f"(select doc_id, t term, count(*) tf from (select doc_id, unnest({_SUBTOKENS.format('w')}) t from (select doc_id, unnest(regexp_split_to_array(text, '\\s+')) w from documents where text is not null)) group by 1, 2)"


def bm25_sql(terms: list[str], fuzzy: bool, texts: str = "(select doc_id, text from documents where text is not null)") -> str:
    words = f"(select doc_id, t term, count(*) tf from (select doc_id, unnest({_SUBTOKENS.format('w')}) t from (select doc_id, unnest(regexp_split_to_array(text, '\\s+')) w from {texts})) group by 1, 2)"
    t = ", ".join(f"('{x}')" for x in terms)
    grams = "list_distinct(list_transform(range(1, length('^^' || {0} || '$$') - 1), lambda i: substr('^^' || {0} || '$$', i, 3)))"
    near = f"""union all select query, term, dice from (select q.query, v.term, 2.0 * len(list_intersect(q.g, v.g)) / (len(q.g) + len(v.g)) dice, row_number() over (partition by q.query order by 2.0 * len(list_intersect(q.g, v.g)) / (len(q.g) + len(v.g)) desc, v.term) r
        from (select query, {grams.format('query')} g from q where query not in (select term from w)) q, (select term, {grams.format('term')} g from (select distinct term from w)) v where 2.0 * len(list_intersect(q.g, v.g)) / (len(q.g) + len(v.g)) >= 0.6) where r <= 3"""
    return f"""with w as materialized {words}, q as (select * from (values {t}) v(query)), u as (select query, query term, 1.0 share from q where query in (select term from w) {near if fuzzy else ''}),
    len_ as (select d.doc_id, coalesce(sum(tf), 0) len from (select distinct doc_id from {texts}) d left join w using (doc_id) group by 1), st as (select count(*) n, avg(len) av from len_), df as (select term, count(*) df from w where term in (select term from u) group by 1)
    select w.doc_id doc, round(sum(share * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / av))), 4) score, array_to_string(list_sort(list(distinct query) filter (query = term)), ',') matched, coalesce(array_to_string(list_sort(list(distinct query) filter (query <> term)), ','), '') fuzzy
    from w join u using (term) join df using (term) join len_ using (doc_id), st group by 1"""


@query("q1_bm25", bm25_sql(["iron", "bell", "tower"], False) + " order by score desc, doc limit 20")
def q1_bm25(spark, d):
    return S.bm25(docs(spark, d), "doc_id", F.col("text"), "iron bell of the tower", fuzzy=False)


@query("q3_bm25_fuzzy", bm25_sql(["iron", "bell", "tower", "clockmakr"], True) + " order by score desc, doc limit 20")
def q3_bm25_fuzzy(spark, d):
    return S.bm25(docs(spark, d), "doc_id", F.col("text"), QUESTION)


@query("a11_postings", f"select term, count(*) df, sum(tf)::bigint tf from {_WORDS} group by term")
def a11_postings(spark, d):
    return S.postings(docs(spark, d), "doc_id", F.col("text")).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


@query("q2_trigrams", f"""with v as (select distinct ident term from {IDS}), q as (select * from (values ('contxt'), ('optons'), ('undefind')) q(query)),
    g as (select query, list_distinct(list_transform(range(1, length('^^' || query || '$$') - 1), lambda i: substr('^^' || query || '$$', i, 3))) qg from q), h as (select term, list_distinct(list_transform(range(1, length('^^' || term || '$$') - 1), lambda i: substr('^^' || term || '$$', i, 3))) tg from v)
    select query, term, round(dice, 6) dice from (select query, term, 2.0 * len(list_intersect(qg, tg)) / (len(qg) + len(tg)) dice, row_number() over (partition by query order by 2.0 * len(list_intersect(qg, tg)) / (len(qg) + len(tg)) desc, term) r from g, h where 2.0 * len(list_intersect(qg, tg)) / (len(qg) + len(tg)) >= 0.6) where r <= 3""")
def q2_trigrams(spark, d):
    return S.dice(["contxt", "optons", "undefind"], idents(spark, d).select(F.col("ident").alias("term"))).select("query", "term", F.round("dice", 6).alias("dice"))


VECTORS_SQL = "(select vec_id, label, list_transform(embedding, lambda x: greatest(-127, least(127, round_even(x::double / sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double))) * 127, 0)))::int) q from embeddings)"


#: The vectors that searches ask with.
QUERY_SET = "vec_id % 100 = 0"


def vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", T.quantised(F.col("embedding")).alias("q"))


@query("a15_int8", f"select vec_id, array_to_string(q, ',') q from {VECTORS_SQL}")
def a15_int8(spark, d):
    return vectors(spark, d).select("vec_id", F.array_join(F.transform("q", lambda x: x.cast("string")), ",").alias("q"))


@query("q8_knn", f"with v as materialized {VECTORS_SQL}, s as (select q.vec_id query_id, v.vec_id, list_dot_product(v.q::double[], q.q::double[])::bigint dot from v, (select * from v where vec_id % 100 = 0) q) select query_id, vec_id, dot from (select *, row_number() over (partition by query_id order by dot desc, vec_id) r from s) where r <= 20")
def q8_knn(spark, d):
    """The nearest 20 of every vector of the query set."""
    v = written(vectors(spark, d), "vectors")
    return S.nearest_of_set(v, v.where(QUERY_SET), "vec_id", "q")


@query("a17_best_per_group", f"with v as materialized {VECTORS_SQL}, s as (select q.vec_id query_id, v.label, v.vec_id, list_dot_product(v.q::double[], q.q::double[])::bigint dot from v, (select * from v where vec_id % 100 = 0) q) select query_id, label, vec_id, dot from (select *, row_number() over (partition by query_id, label order by dot desc, vec_id) r from s) where r = 1")
def a17_best_per_group(spark, d):
    """The best of each label for every vector of the query set."""
    v = written(vectors(spark, d), "vectors")
    return S.best_of_set(v, v.where(QUERY_SET), "label", "vec_id", "q")


@query("j40_rrf", """with a as (select doc_id k, row_number() over (order by n_chars desc nulls last, doc_id) r from documents), b as (select doc_id k, row_number() over (order by uploaded_at desc nulls last, doc_id) r from documents)
    select k, round(sum(1.0::double / (60 + r)), 6) score from (select * from a where r <= 200 union all select * from b where r <= 200) group by k""")
def j40_rrf(spark, d):
    t = table(spark, d, "documents")

    def ranked(order):
        from pyspark.sql import Window

        top = t.orderBy(order.desc_nulls_last(), "doc_id").limit(200)
        return top.select(F.col("doc_id").alias("k"), F.row_number().over(Window.orderBy(order.desc_nulls_last(), "doc_id")).alias("r"))

    return S.fused([ranked(F.col("n_chars")), ranked(F.col("uploaded_at"))], "k", "r")


@query("q10_grep", r"select doc_id, line, text from (select doc_id, unnest(string_split(text, E'\n')) text, generate_subscripts(string_split(text, E'\n'), 1) line from documents where text is not null) where regexp_matches(text, '[Ii]ron (bell|gate)') order by doc_id, line limit 200")
def q10_grep(spark, d):
    return S.grep(docs(spark, d), "doc_id", "text", "[Ii]ron (bell|gate)")


@query("q11_find_symbol", f"select distinct file, line, name, kind, parent, name = 'run' exact from {SYMS} where name = 'run' order by file, line, kind limit 50")
def q11_find_symbol(spark, d):
    return S.find_symbol(symbols(spark, d), "run")


@query("q12_overview", f"select distinct line, name, kind, parent from {SYMS} where file = (select min(file) from symbols)")
def q12_overview(spark, d):
    s = symbols(spark, d)
    return S.overview(s, s.agg(F.min("file")).first()[0])


@query("q13_references", f"select distinct file, 'definition' how from {SYMS} where name = 'handle' union all select distinct file, 'reference' from {IDS} where ident = 'handle' and ((select count(distinct file) from {SYMS} where name = 'handle') <> 1 or file <> (select min(file) from {SYMS} where name = 'handle'))")
def q13_references(spark, d):
    return S.references(written(symbols(spark, d), "symbols"), idents(spark, d), "handle")


@query("sk10_repo_map", f"""with r as (select file, pos, kind, name, row_number() over (partition by file order by exported desc nulls last, line nulls first, pos) r from {SYMS}),
    l as (select file, string_agg('  ' || coalesce(kind, '') || ' ' || coalesce(name, ''), E'\\n' order by r) lines from r where r <= {K.MAP_SYMBOLS} group by file),
    b as (select rel, row_number() over (order by pagerank desc nulls last, symbols desc nulls last, rel) rank, rel || E'\\n' || coalesce(lines || E'\\n', '') block from {NODES} n left join l on l.file = n.rel)
    select rank::int rank, rel, block from (select *, sum(length(block)) over (order by rank) upto from b) where upto <= {K.MAP_TOKENS * K.CHARS_PER_TOKEN}""")
def sk10_repo_map(spark, d):
    return S.repo_map(nodes(spark, d), symbols(spark, d))


@query("sk2_symbol_index", f"select name, file, line, kind, pos, coalesce(end_line, -1) end_line, exported, lang, parent from {SYMS} where name is not null")
def sk2_symbol_index(spark, d):
    """Every definition of every name, one row each: a hot name needs no list of its own."""
    return symbols(spark, d).where("name is not null").select("name", "file", "line", "kind", "pos", F.coalesce("end_line", F.lit(-1)).alias("end_line"), "exported", "lang", "parent")


@query("sk11_mermaid", f"select src_module, dst_module, weight, kind from {LIFT_SQL} order by weight desc, src_module, dst_module limit 80")
def sk11_mermaid(spark, d):
    return module_edges(spark, d).orderBy(F.desc("weight"), "src_module", "dst_module").limit(K.MERMAID_EDGES)


# history: a commit is an order, a file a brand or a part

_COMMITS = "(select distinct l_orderkey c, p_brand f from lineitem join part on l_partkey = p_partkey)"


def commits(spark, d):
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    return li.join(p, li["l_partkey"] == p["p_partkey"]).select(F.col("l_orderkey").alias("commit_id"), F.col("p_brand").alias("file")).distinct()


@query("a2_churn", f"select f file, count(*) commits from {_COMMITS} group by f")
def a2_churn(spark, d):
    return H.churn(commits(spark, d))


@query("g18_coupling", f"with s as (select c, f from {_COMMITS} where c in (select c from {_COMMITS} group by c having count(*) <= 30)), n as (select f, count(*) n from s group by f) select a.f a, b.f b, count(*) together, round(count(*) / least(any_value(x.n), any_value(y.n)), 3) strength from s a join s b on a.c = b.c and a.f < b.f join n x on x.f = a.f join n y on y.f = b.f group by a.f, b.f having count(*) >= 3 order by strength desc, together desc, a, b limit 100")
def g18_coupling(spark, d):
    return H.coupling(commits(spark, d))


@query("g19_hotspots", f"select rel, c commits, lines, round(c * log2(lines + 1), 2) score from {FILES} f join (select dst, count(*) c from {EDGES} where not dangling group by dst) x on f.rel = x.dst order by score desc, lines desc, rel limit 20")
def g19_hotspots(spark, d):
    """Links to a file stand for its commits."""
    c = edges(spark, d).where("not dangling").groupBy(F.col("dst").alias("file")).agg(F.count(F.lit(1)).alias("commits"))
    return H.hotspots(files(spark, d).select("rel", "lines"), c)


@query("g19_risk", f"select f.rel, coalesce(c, 0) commits, s.n complexity, (coalesce(c, 0) + 1) * s.n score from {FILES} f join (select file, count(*) n from {SYMS} group by file) s on s.file = f.rel left join (select dst, count(*) c from {EDGES} where not dangling group by dst) x on f.rel = x.dst order by score desc, f.rel limit 20")
def g19_risk(spark, d):
    c = edges(spark, d).where("not dangling").groupBy(F.col("dst").alias("file")).agg(F.count(F.lit(1)).alias("commits"))
    n = symbols(spark, d).groupBy(F.col("file").alias("rel")).agg(F.count(F.lit(1)).alias("complexity"))
    return H.risk(files(spark, d).select("rel").join(n, "rel"), c)


@query("a20_complexity", f"""with l as (select doc_id, string_split(text, E'\\n') ls from documents where text is not null), b as (select doc_id, ls, unnest(range(0, len(ls), 10)) s from l), x as (select doc_id::varchar file, 'block' || s name, (s + 1)::int line, array_to_string(ls[s + 1:s + 10], E'\\n') body from b)
    select file, name, line, {_complexity_sql('body')} complexity from x order by complexity desc, file, line limit {K.TOP_COMPLEXITY}""")
def a20_complexity(spark, d):
    """The symbols with most branches; blocks of ten lines of the documents stand for symbols with a content."""
    t = docs(spark, d).select(F.col("doc_id").cast("string").alias("file"), F.col("text").alias("content"))
    n = F.size(F.split("content", "\n"))
    s = t.select("file", F.explode(F.sequence(F.lit(0), n - 1, F.lit(10))).alias("s"))
    s = s.select("file", F.concat(F.lit("block"), "s").alias("name"), F.lit("block").alias("kind"), (F.col("s") + 1).alias("line"), (F.col("s") + 10).alias("end_line"))
    return R.symbol_complexity(s, t).withColumn("complexity", F.col("complexity").cast("bigint"))


@query("j34_pairs_in_events", "select a.event_type a, b.event_type b, count(*) together from (select distinct user_id, event_type from events) a join (select distinct user_id, event_type from events) b on a.user_id = b.user_id and a.event_type < b.event_type group by 1, 2 having count(*) >= 3")
def j34_pairs_in_events(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("commit_id"), F.col("event_type").alias("file"))
    return H.coupling(e, pairs=None).select("a", "b", "together")
