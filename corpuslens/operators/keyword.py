"""Keyword retrieval for a whole table of queries.

How well a query identifier matches a chunk identifier depends on the two surfaces only, so tiers
are found between the query terms and the *vocabulary* of each project, blocked on shared
trigrams.  The matched surfaces of a block of queries then meet each pack of postings of the project in
an equi join; a pack is scored where it lies, and per query only chunks leave the task that stand before the
last of its best so far, by score and stable order, as many as the query keeps.  A pack whose terms cannot
reach these is skipped for that query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import text as tx
from corpuslens.functions.joins import join_small, of_asked_projects
from corpuslens.functions.ordered import top_per_key
from corpuslens.operators.postings import (
    Index,
    build_index,
    document_identifiers,
    query_terms,
    with_grams,
)
from corpuslens.schema import STABLE_KEYS, stable_order
from corpuslens.session import durable

# Tier scores and thresholds.
EXACT, CONTAINED, SIMILAR = 5, 3, 2
MIN_OVERLAP = 0.5
MIN_LENGTH_RATIO = 0.4
MAX_TERM_SCORE = 4.0
EVIDENCE = (
    "exact_identifiers", "exact_ascii_terms", "exact_cjk_terms", "contained_identifiers",
    "ngram_matches",
)

#: Queries of a block (a pack is sent once per block), lookups that a task holds read, and best chunks of queries
#: that it remembers.
QUERY_BLOCK = 512
HELD_LOOKUPS = 400_000
REMEMBERED = 200_000
_HITS = (
    "query_id string, project_id string, document_name string, chunk_index int, document_id string, chunk_id string, "
    + ", ".join(f"{name} int" for name in EVIDENCE) + ", keyword_score double"
)


def _needed(size: Column) -> Column:
    return F.ceil(size * MIN_OVERLAP).cast("int")


def boundary_contained(short: Column, long: Column) -> Column:
    """``short`` lies inside ``long`` at a boundary: at the end, or where the character class
    changes or a separator stands on each inner side."""
    at = F.instr(long, short)
    end = at + F.char_length(short)
    one = F.lit(1)
    before = F.substring(long, F.greatest(at - 1, one), one)
    after = F.substring(long, end, one)
    first = F.substring(short, one, one)
    last = F.substring(short, F.char_length(short), one)

    def changes(outer: Column, inner: Column) -> Column:
        return (
            outer.rlike(r"^[.\-_/:+]$")
            | (inner.rlike("^[a-z]$") != outer.rlike("^[a-z]$"))
            | (inner.rlike("^[0-9]$") != outer.rlike("^[0-9]$"))
        )

    at_end = end == F.char_length(long) + 1
    return (
        (at > 0)
        & (F.char_length(short) / F.char_length(long) >= MIN_LENGTH_RATIO)
        & (
            F.when(at == 1, at_end | changes(after, last))
            .when(at_end, True)
            .otherwise(changes(before, first) & changes(after, last))
        )
    )


def _final_number(surface: Column) -> Column:
    return F.regexp_extract(surface, r"(\d+)$", 1)


def similar(left: Column, right: Column) -> Column:
    """Neither contains the other, and they do not end in different numbers.  The trigram
    overlap itself is tested on the pairs before."""
    left_end, right_end = _final_number(left), _final_number(right)
    numbers_differ = (left_end != "") & (right_end != "") & (left_end != right_end)
    return ~F.contains(left, right) & ~F.contains(right, left) & ~numbers_differ


def overlapping(pairs: DataFrame) -> DataFrame:
    """Pairs sharing at least half the smaller trigram set; contained pairs share all of it."""
    shared = F.size(F.array_intersect("_mine", "_theirs"))
    smaller = F.least(F.size("_mine"), F.size("_theirs"))
    return (
        pairs.withColumn("_mine", tx.trigrams(F.col("mine")))
        .withColumn("_theirs", tx.trigrams(F.col("theirs")))
        .where(shared / smaller >= MIN_OVERLAP)
        .drop("_mine", "_theirs")
    )


def scope_vocabulary(index: Index, terms: DataFrame, scoped: bool = True) -> DataFrame:
    """Distinct identifiers of the asked projects, and of the documents that queries name."""
    asked = terms.select("project_id").distinct()
    by_project = join_small(index.vocabulary, asked, ["project_id"], "left_semi").withColumn("scope", F.lit(""))
    if not scoped:
        return by_project
    documents = durable(terms.where(F.col("scope") != "").select("project_id", "scope").distinct())
    by_document = with_grams(document_identifiers(index.packs, documents), index.counts)
    return by_project.unionByName(by_document)


def similarity_candidates(mine: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Pairs of different surfaces that may share half the smaller trigram set.

    Prefix filter: such a pair shares a trigram with the first ``n - need + 1`` trigrams, rare ones
    first, of its shorter member.  Each side's prefixes are cut before they meet all trigrams of the
    other, once per side, so rare trigrams block and common ones hardly ever reach a join."""

    def exploded(df: DataFrame, name: str) -> DataFrame:
        count = F.size("grams")
        return (
            df.where("size(grams) > 0")
            .select("project_id", "scope", "surface", "grams")
            .dropDuplicates(["project_id", "scope", "surface"])
            .select(
                "project_id",
                "scope",
                F.col("surface").alias(name),
                count.alias(f"{name}_n"),
                (count - _needed(count) + 1).alias(f"{name}_prefix"),
                F.posexplode("grams").alias(f"{name}_at", "gram"),
            )
        )

    left, right = exploded(mine, "mine"), exploded(vocabulary, "theirs")
    on = ["project_id", "scope", "gram"]
    pair = ["project_id", "scope", "mine", "theirs"]
    mine_leads = join_small(right, left.where("mine_at < mine_prefix"), on).where("mine_n <= theirs_n")
    theirs_leads = join_small(right.where("theirs_at < theirs_prefix"), left, on).where("theirs_n < mine_n")
    both = mine_leads.select(*pair).unionByName(theirs_leads.select(*pair))
    return both.where(F.col("mine") != F.col("theirs")).distinct()


def identifier_tiers(terms: DataFrame, vocabulary: DataFrame, counts: DataFrame) -> DataFrame:
    """(query, gid, kind, surface, tier): matched vocabulary, similar ones only where the group
    has nothing stronger anywhere in its project or document.  ``counts`` orders trigrams."""
    identifiers = durable(with_grams(terms.where(F.col("kind").isin("w", "d")), counts))
    keys = ["project_id", "scope"]
    exact = join_small(
        vocabulary.where("kind = 'w'"),
        identifiers.where("kind = 'w'").select(*keys, "query_id", "gid", "surface"),
        [*keys, "surface"],
    ).select(*keys, "query_id", "gid", "kind", "surface", F.lit(EXACT).alias("tier"))

    pairs = overlapping(similarity_candidates(identifiers, vocabulary))
    mine, theirs = F.col("mine"), F.col("theirs")
    shorter_mine = F.char_length(mine) <= F.char_length(theirs)
    contained = F.when(shorter_mine, boundary_contained(mine, theirs)).otherwise(
        boundary_contained(theirs, mine)
    )
    judged = (
        pairs.withColumn("contained", contained)
        .withColumn("similar", ~F.col("contained") & similar(mine, theirs))
        .where("contained or similar")
    )
    loose = (
        judged.join(
            identifiers.select(
                *keys, "query_id", "gid", F.col("kind").alias("my_kind"), F.col("surface").alias("mine")
            ),
            [*keys, "mine"],
        )
        .join(
            # Which kinds the matched surface has in the vocabulary.
            vocabulary.select(*keys, "kind", F.col("surface").alias("theirs")), [*keys, "theirs"]
        )
        .select(
            *keys,
            "query_id",
            "gid",
            "kind",
            theirs.alias("surface"),
            F.when(
                F.col("contained") & (F.col("my_kind") == "w") & (F.col("kind") == "w"), CONTAINED
            )
            .when(F.col("similar"), SIMILAR)
            .alias("tier"),
        )
        .where(F.col("tier").isNotNull())
    )
    best = durable(
        exact.unionByName(loose)
        .groupBy(*keys, "query_id", "gid", "kind", "surface")
        .agg(F.max("tier").alias("tier"))
    )
    # A group's surfaces are few next to the postings they stand for, so its strongest tier is
    # found here, before any posting is read.
    strongest = best.groupBy("query_id", "gid").agg(F.max("tier").alias("strongest"))
    return best.join(strongest, ["query_id", "gid"]).where(
        (F.col("tier") > SIMILAR) | (F.col("strongest") <= SIMILAR)
    ).drop("strongest")


def _query_blocks(queries: DataFrame, terms: DataFrame, tiers: DataFrame, limit: Column) -> DataFrame:
    """(project, asked): blocks of about ``QUERY_BLOCK`` queries with the surfaces they look up and how many chunks they keep."""
    general = terms.where(F.col("kind").isin("a", "c")).select(
        "query_id", "gid", "kind", "surface", F.lit(0).alias("tier"), "weight"
    )
    lookups = tiers.select("query_id", "gid", "kind", "surface", "tier", F.lit(0).alias("weight")).unionByName(general)
    wanted = lookups.groupBy("query_id").agg(
        F.collect_list(F.struct(F.concat("kind", "surface").alias("key"), "gid", "tier", "weight")).alias("lookups")
    )
    base = queries.select("query_id", "project_id", "scope", limit.cast("int").alias("limit")).join(wanted, "query_id")
    sizes = base.groupBy("project_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERY_BLOCK)).alias("_blocks"))
    return (
        base.join(sizes, "project_id")
        .withColumn("_block", F.pmod(F.xxhash64("query_id"), F.col("_blocks")))
        .groupBy("project_id", "_block")
        .agg(F.collect_list(F.struct("query_id", "scope", "limit", "lookups")).alias("asked"))
        .drop("_block")
    )


class _Pack:
    """One pack of postings and the scores of its chunks."""

    def __init__(self, row: dict[str, pa.Array]):
        self.keys = {key: row[f"{key}s"] for key in STABLE_KEYS}
        self.surfaces = row["surfaces"]
        self.starts, self.entries = row["starts"].to_numpy(), row["entries"].to_numpy()
        self.size = len(row["chunk_ids"])
        self._known: dict[int, tuple] = {}

    def key(self, row: int) -> tuple:
        """What orders a chunk among equal scores: its stable keys, nulls first."""
        if row not in self._known:
            values = [self.keys[key][row].as_py() for key in STABLE_KEYS]
            self._known[row] = tuple(part for value in values for part in (value is not None, value))
        return self._known[row]

    def score(self, lookups: list[tuple], places: list[int | None], last: tuple | None) -> dict | None:
        """Evidence and score of every chunk; nothing where no chunk can stand before ``last``, a (-score, key)."""
        present = [(*wanted, place) for wanted, place in zip(lookups, places, strict=True) if place is not None]
        strongest: dict[int, int] = {}
        for _, gid, tier, _, _ in present:
            if tier:
                strongest[gid] = max(strongest.get(gid, 0), tier)
        bound = sum(strongest.values()) + min(sum(weight for _, _, _, weight, _ in present), MAX_TERM_SCORE)
        if not present or (last is not None and (-bound, self.key(0)) > last):
            return None
        counts = {name: np.zeros(self.size, np.int32) for name in EVIDENCE}
        tiers = {gid: np.zeros(self.size, np.int8) for gid in strongest}
        for kind, gid, tier, weight, place in present:
            holders = self.entries[self.starts[place] : self.starts[place + 1]]
            if tier:
                mine = tiers[gid]
                mine[holders] = np.maximum(mine[holders], tier)
            else:
                counts["exact_ascii_terms" if kind == "a" else "exact_cjk_terms"][holders] += weight
        for mine in tiers.values():
            for tier, name in ((EXACT, "exact_identifiers"), (CONTAINED, "contained_identifiers"), (SIMILAR, "ngram_matches")):
                counts[name] += mine == tier
        score = EXACT * counts["exact_identifiers"] + CONTAINED * counts["contained_identifiers"] + SIMILAR * counts["ngram_matches"]
        score = score + np.minimum((counts["exact_ascii_terms"] + counts["exact_cjk_terms"]).astype(float), MAX_TERM_SCORE)
        return {**counts, "keyword_score": score}


class _Best:
    """The best chunks that a task has seen of each query, as sorted (-score, key).

    They are few per query; beyond ``REMEMBERED`` in all, queries of other projects are forgotten, and new ones are not
    remembered, so more of their chunks leave the task than have to."""

    def __init__(self) -> None:
        self.held: dict[str | None, dict[str, list[tuple]]] = {}
        self.count = 0

    def of(self, project: str | None, query: str) -> list[tuple]:
        return self.held.get(project, {}).get(query, [])

    def put(self, project: str | None, query: str, best: list[tuple]) -> None:
        mine = self.held.setdefault(project, {})
        more = len(best) - len(mine.get(query, ()))
        if self.count + more > REMEMBERED:
            self.held = {project: mine}
            self.count = sum(map(len, mine.values()))
            if self.count + more > REMEMBERED:
                return
        mine[query] = best
        self.count += more


def _ahead(pack: _Pack, rows: np.ndarray, score: np.ndarray, known: list[tuple], limit: int) -> tuple[list[int], list[tuple]]:
    """Of chunks in order, those among the query's best ``limit`` so far, and the best with them."""
    last = known[limit - 1] if len(known) >= limit else None
    kept, entries = [], []
    for row in rows[:limit].tolist():
        entry = (-float(score[row]), pack.key(row))
        if last is not None and entry > last:
            break
        kept.append(row)
        entries.append(entry)
    best = sorted(known + entries)[:limit]
    # What the chunks of this pack push out does not count any more.
    fits = sum(entry <= best[-1] for entry in entries) if best else 0
    return kept[:fits], best


def _read_block(block: pa.StructArray) -> tuple[pa.Array, list[tuple]]:
    """(keys, asks): what all queries of a block look up, and per query its id, scope, limit and lookups
    (kind, gid, tier, weight) in the order of the keys."""
    lookups = block.field("lookups")
    flat = lookups.flatten()
    keys = pc.take(flat.field("key"), pa.array(np.arange(len(flat))))  # a copy: the batch need not be kept for it
    columns = (pc.utf8_slice_codeunits(keys, 0, 1), *map(flat.field, ("gid", "tier", "weight")))
    values = list(zip(*(column.to_pylist() for column in columns), strict=True))
    ends = np.cumsum(lookups.value_lengths().to_numpy()).tolist()
    parts = [values[first:end] for first, end in zip([0, *ends], ends)]
    return keys, list(zip(*(block.field(name).to_pylist() for name in ("query_id", "scope", "limit")), parts, strict=True))


def _score_packs():
    names = [field.split()[0] for field in _HITS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best()
        read: dict[tuple, tuple[pa.Array, list[tuple]]] = {}  # a block meets many packs
        held = 0
        for batch in batches:
            for at in range(batch.num_rows):
                project, block = batch.column("project_id")[at].as_py(), batch.column("asked")[at].values
                of = (project, *block.field("query_id").to_pylist())
                if of not in read:
                    wanted, asked = _read_block(block)
                    if held + len(wanted) > HELD_LOOKUPS:
                        read.clear()
                        held = 0
                    read[of], held = (wanted, asked), held + len(wanted)
                wanted, asked = read[of]
                pack = _Pack({name: batch.column(name)[at].values for name in batch.schema.names if name not in ("project_id", "asked")})
                places = pc.index_in(wanted, value_set=pack.surfaces).to_pylist()
                found: dict[str, list] = {name: [] for name in names}
                first = 0
                for query, scope, limit, lookups in asked:
                    mine = places[first : first + len(lookups)]
                    first += len(lookups)
                    known = best.of(project, query)
                    scored = pack.score(lookups, mine, known[limit - 1] if len(known) >= limit else None)
                    if scored is None:
                        continue
                    score = scored["keyword_score"]
                    fits = (score > 0) & (score >= (-known[limit - 1][0] if len(known) >= limit else 0.0))
                    if scope:
                        fits &= pc.equal(pack.keys["document_id"], scope).fill_null(False).to_numpy(zero_copy_only=False)
                    rows = np.flatnonzero(fits)
                    # Rows are in stable order, so of equal scores the earlier rows win.
                    rows, now = _ahead(pack, rows[np.argsort(-score[rows], kind="stable")], score, known, limit)
                    if not rows:
                        continue
                    best.put(project, query, now)
                    taken = pa.array(rows, pa.int64())
                    for name in names:
                        if name in scored:
                            found[name].append(pa.array(scored[name][rows]))
                        elif name in pack.keys:
                            found[name].append(pack.keys[name].take(taken))
                        else:
                            found[name].append(pa.array([query if name == "query_id" else project] * len(rows), pa.string()))
                if found["query_id"]:
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in found.values()], names=names)

    return run


def score_packs(
    packs: DataFrame, queries: DataFrame, terms: DataFrame, tiers: DataFrame, top_k: int, limit: Column | None = None
) -> DataFrame:
    """The best chunks of each pack for each query, with evidence and score, but for those that a task has seen
    enough better ones of.  ``limit`` narrows how many a query keeps, up to ``top_k``."""
    keeps = F.lit(top_k) if limit is None else F.greatest(F.least(limit, F.lit(top_k)), F.lit(1))
    blocks = durable(_query_blocks(queries, terms, tiers, keeps))
    # A question limited to one document meets only the packs that hold it, and a pack that no
    # question meets never reaches Python.
    meets = F.filter("asked", lambda ask: (ask["scope"] == "") | F.array_contains("document_ids", ask["scope"]))
    met = join_small(packs, blocks, ["project_id"]).withColumn("asked", meets).where(F.size("asked") > 0)
    return met.mapInArrow(_score_packs(), _HITS)


def with_scope(queries: DataFrame) -> DataFrame:
    """``scope``: the one document a query is limited to, else empty."""
    if "document_id" in queries.columns:
        return queries.withColumn("scope", F.coalesce(F.col("document_id").cast("string"), F.lit("")))
    return queries.withColumn("scope", F.lit(""))


def retrieve_keyword(
    queries: DataFrame,
    chunks: DataFrame | None,
    top_k: int,
    index: Index | None = None,
    limit: Column | None = None,
) -> DataFrame:
    """Top chunks per query by lexical score.

    ``queries``: query_id, project_id, query, optional document_id.  Pass a stored ``index`` so that no
    text of the corpus is read; without it one is built from ``chunks`` of the asked projects.
    ``limit`` narrows the cut per query, up to ``top_k``."""
    if index is None:
        index = build_index(of_asked_projects(chunks, queries))
    else:
        index = Index(of_asked_projects(index.packs, queries), index.vocabulary, index.counts)
    scoped = with_scope(queries)
    terms = durable(query_terms(scoped))
    vocabulary = durable(scope_vocabulary(index, terms, "document_id" in queries.columns))
    tiers = identifier_tiers(terms, vocabulary, index.counts)
    scored = score_packs(index.packs, scoped, terms, tiers, top_k, limit)
    ranked = top_per_key(
        scored, ["query_id"], [F.col("keyword_score").desc(), *stable_order()], top_k, "rank"
    )
    if limit is not None:
        limits = queries.select("query_id", limit.alias("_limit"))
        ranked = ranked.join(limits, "query_id").where(F.col("rank") <= F.col("_limit")).drop("_limit")
    return ranked
