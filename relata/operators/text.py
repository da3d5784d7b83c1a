"""Operators on annotated sentences: canonical names, concepts, coreference, entity pairs, dependency paths, propositions.

A sentence row holds its tokens, mentions and chunks as arrays (relata.schemas.SENTENCES). Pairs and paths are array
expressions on that row, so extraction is a narrow map without a shuffle; only per-document steps (glosses, concepts,
antecedents) group by doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relata.config import ARROW, DEFAULT, Config
from relata.functions import text as T

# fixed values: dependency labels by role
SUBJECT = ("nsubj", "nsubjpass", "agent", "expl", "csubj")
OBJECT = ("dobj", "obj", "pobj", "dative", "attr", "oprd", "iobj")
PASSIVE_SUBJECT = ("nsubjpass", "nsubj:pass", "auxpass", "csubjpass")
AGENT = ("agent",)
# fixed values: entity labels
COREF_LABELS = ("PERSON", "ORG", "GPE", "PRODUCT")
ACRONYM_LABELS = ("ORG", "GPE", "PRODUCT")


def mentions(sentences: DataFrame) -> DataFrame:
    """(doc_id, sent_id, ent_idx, start, end, root, text, label)."""
    return sentences.select("doc_id", "sent_id", F.posexplode("mentions").alias("ent_idx", "_m")).select("doc_id", "sent_id", "ent_idx", "_m.*")


def tokens(sentences: DataFrame) -> DataFrame:
    return sentences.select("doc_id", "sent_id", F.explode("tokens").alias("_t")).select("doc_id", "sent_id", "_t.*")


# ---- names ------------------------------------------------------------------------------------------------------------


def glosses(docs: DataFrame) -> DataFrame:
    """(doc_id, alias, canonical) from "Full Name (FN)" and "FN (Full Name)"; a later match, and the second order, wins."""

    def found(pattern: str, full: int, rank: int) -> Column:
        whole = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        part = lambda m, k: F.regexp_extract(m, pattern, k)
        return F.transform(whole, lambda m, i: F.struct(F.lit(rank).alias("_r"), i.alias("_i"), part(m, full).alias("f"), part(m, 3 - full).alias("a")))

    # both patterns need a parenthesis, so texts without one are not searched; one reading for both
    lists = F.concat(found(T.FULL_THEN_SHORT, 1, 0), found(T.SHORT_THEN_FULL, 2, 1))
    both = docs.where(F.contains("text", F.lit("("))).select("doc_id", F.explode(F.array(lists)).alias("_l")).select("doc_id", F.explode("_l").alias("_z"))
    both = both.select("doc_id", "_z._r", "_z._i", T.normalize_surface(F.col("_z.f")).alias("canonical"), T.normalize_surface(F.col("_z.a")).alias("alias"))
    ok = both.where((F.col("alias") != "") & (F.col("canonical") != "") & (F.col("alias") != F.col("canonical")) & (F.length(F.replace("alias", F.lit(" "))) <= 9))
    return ok.groupBy("doc_id", "alias").agg(F.max_by("canonical", F.struct("_r", "_i")).alias("canonical"))


def initial_glosses(ments: DataFrame) -> DataFrame:
    """(doc_id, alias, canonical): all-capital organisations, places and products to names with those initials in the same document."""
    m = ments.where(F.col("label").isin(*ACRONYM_LABELS)).withColumns({"_n": T.normalize_surface(F.col("text")), "_at": F.struct("sent_id", "ent_idx")})
    m = m.withColumns({"_c": F.replace("_n", F.lit(" ")), "_w": F.split("_n", " ")})
    short = m.where(T.is_upper(F.replace(F.col("text"), F.lit("."))) & F.length("_c").between(2, 6)).groupBy("doc_id", "_c").agg(F.max_by("_n", "_at").alias("alias"))
    full = m.where(F.size("_w") >= 2).withColumn("_c", T.initials(F.col("_w"))).groupBy("doc_id", "_c").agg(F.max_by("_n", "_at").alias("canonical"))
    return short.join(full, ["doc_id", "_c"]).where("alias <> canonical").select("doc_id", "alias", "canonical")


def name_map(docs: DataFrame, ments: DataFrame) -> DataFrame:
    """Glosses of each document; initials never override a written gloss."""
    written = glosses(docs)
    return written.unionByName(initial_glosses(ments).join(written.select("doc_id", "alias"), ["doc_id", "alias"], "left_anti"))


def canonical(df: DataFrame, surface: str, names: DataFrame, aliases: DataFrame | None = None, out: str = "canonical", most_aliases: int = 1_000_000) -> DataFrame:
    """Adds ``out``: the runtime alias, else the document's gloss, else the normal form. aliases: (alias, canonical); broadcast
    only up to ``most_aliases`` rows."""
    df = df.withColumn("_n", T.normalize_surface(F.col(surface)))
    df = df.join(names.select("doc_id", F.col("alias").alias("_n"), F.col("canonical").alias("_doc")), ["doc_id", "_n"], "left")
    if aliases is None:
        return df.withColumn(out, F.coalesce("_doc", "_n")).drop("_n", "_doc")
    a = aliases.groupBy(T.normalize_surface(F.col("alias")).alias("_n")).agg(F.max(F.lower(F.trim("canonical"))).alias("_run"))
    if aliases.limit(most_aliases + 1).count() <= most_aliases:
        a = F.broadcast(a)
    return df.join(a, "_n", "left").withColumn(out, F.coalesce("_run", "_doc", "_n")).drop("_n", "_doc", "_run")


def concepts(ments: DataFrame, chunks: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(doc_id, concept, type, surface, confidence, sources): entities by canonical name, then noun chunks of several words that are none.

    ments: with ``canonical``; chunks: (doc_id, sent_id, start, text, lemma). The first in the text gives type and surface.
    """
    at = F.struct("sent_id", "start")
    first = ments.groupBy("doc_id", F.col("canonical").alias("concept")).agg(F.min_by("label", at).alias("type"), F.min_by("text", at).alias("surface"))
    ents = first.select("doc_id", "concept", "type", "surface", F.lit(cfg.conf_ner).alias("confidence"), F.array(F.lit("NER")).alias("sources"))
    c = chunks.withColumn("concept", F.lower("lemma")).where(T.word_count(F.col("concept")) > 1)
    c = c.groupBy("doc_id", "concept").agg(F.min_by("text", at).alias("surface")).join(ents, ["doc_id", "concept"], "left_anti")
    return ents.unionByName(c.select("doc_id", "concept", F.lit("CONCEPT").alias("type"), "surface", F.lit(cfg.conf_noun_chunk).alias("confidence"), F.array(F.lit("NOUN_CHUNK")).alias("sources")))


# ---- coreference --------------------------------------------------------------------------------------------------------


def antecedents(toks: DataFrame, ments: DataFrame) -> DataFrame:
    """(doc_id, sent_id, i, idx, text, antecedent) of pronouns: he and she to the last person, it to the last other entity, they to
    either; entities count from the token after them on. One window over each document's pronouns and entity tokens."""
    inside = ments.where(F.col("label").isin(*COREF_LABELS)).select("doc_id", "sent_id", F.explode(F.sequence("start", F.col("end") - 1)).alias("i"), F.lit(1).alias("_kind"), F.col("text").alias("_e"), (F.col("label") == "PERSON").alias("_person"))
    said = toks.where(F.lower("text").isin(*T.PRONOUNS)).select("doc_id", "sent_id", "i", F.lit(0).alias("_kind"), "idx", "text")
    # only pronouns and entity tokens meet in the window; at one place the pronoun is asked first
    return _last_named(said.unionByName(inside, allowMissingColumns=True))


def _last_named(t: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("sent_id", "i", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    person = F.last(F.when(F.col("_person"), F.col("_e")), ignorenulls=True).over(w)
    other = F.last(F.when(~F.col("_person"), F.col("_e")), ignorenulls=True).over(w)
    t = t.withColumns({"_p": person, "_o": other, "_w": F.lower("text")}).where("_kind = 0")
    who = F.when(F.col("_w").isin(*T.PERSONAL), F.col("_p")).when(F.col("_w").isin(*T.IMPERSONAL), F.col("_o")).otherwise(F.coalesce("_p", "_o"))
    return t.withColumn("antecedent", who).where("antecedent is not null").select("doc_id", "sent_id", "i", "idx", "text", "antecedent")


EVENT = "struct<i:int,_kind:int,idx:int,text:string,_e:string,_person:boolean>"


def kept_sentences(sentences: DataFrame) -> DataFrame:
    """What extraction reads of sentences, in one reading of them: SENTENCES and ``events`` (pronouns, and tokens of entities that they
    can stand for). Sentences without mention, chunk and event are left out; tokens lose idx and text, which are in the events; the
    sentence's text stays where two mentions can make a pair, tokens where there is a mention."""
    one = F.explode(F.array(F.struct("tokens", "mentions"))).alias("_s")
    s = sentences.select("doc_id", "sent_id", "sentence", "chunks", one).select("doc_id", "sent_id", "sentence", "chunks", "_s.tokens", "_s.mentions")
    none = lambda kind: F.lit(None).cast(kind)
    said = F.transform(F.filter("tokens", lambda t: F.lower(t["text"]).isin(*T.PRONOUNS)), lambda t: F.struct(t["i"].alias("i"), F.lit(0).alias("_kind"), t["idx"].alias("idx"), t["text"].alias("text"), none("string").alias("_e"), none("boolean").alias("_person")))
    named = F.filter("mentions", lambda m: m["label"].isin(*COREF_LABELS))
    inside = F.flatten(F.transform(named, lambda m: F.transform(F.sequence(m["start"], m["end"] - 1), lambda i: F.struct(i.alias("i"), F.lit(1).alias("_kind"), none("int").alias("idx"), none("string").alias("text"), m["text"].alias("_e"), (m["label"] == "PERSON").alias("_person")))))
    empty = F.array().cast(f"array<{EVENT}>")
    s = _once(s, events=F.concat(F.coalesce(said.cast(f"array<{EVENT}>"), empty), F.coalesce(inside.cast(f"array<{EVENT}>"), empty)))
    n = F.size("mentions")
    lean = F.transform("tokens", lambda t: F.struct(t["i"].alias("i"), none("int").alias("idx"), none("string").alias("text"), *[t[c].alias(c) for c in ("lemma", "pos", "dep", "head", "is_stop", "is_punct")]))
    s = s.where((n > 0) | (F.size("chunks") > 0) | (F.size("events") > 0))
    return s.select("doc_id", "sent_id", F.when(n > 1, F.col("sentence")).alias("sentence"), F.when(n > 0, lean).alias("tokens"), "mentions", "chunks", "events")


def pronoun_edits(kept: DataFrame) -> DataFrame:
    """(doc_id, idx, length, replacement) for :func:`spliced`, from :func:`kept_sentences`."""
    found = _last_named(kept.select("doc_id", "sent_id", F.inline("events")))
    return found.where("doc_id is not null").select("doc_id", "idx", F.char_length("text").alias("length"), F.col("antecedent").alias("replacement"))


def spliced(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """Adds ``resolved``: each document's text with (idx, length, replacement) spans replaced, right to left."""
    per = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("idx", "length", "replacement")), False).alias("_e"))
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = F.aggregate("_e", text, lambda s, e: F.concat(F.left(s, e["idx"]), e["replacement"], F.substring(s, e["idx"] + e["length"] + 1, F.char_length(s))))
    return docs.join(per, "doc_id", "left").withColumn("resolved", F.coalesce(F.when(F.col("_e").isNotNull(), cut), text)).drop("_e")


def resolve_pronouns(docs: DataFrame, toks: DataFrame, ments: DataFrame) -> DataFrame:
    found = antecedents(toks, ments)
    return spliced(docs, found.select("doc_id", "idx", F.char_length("text").alias("length"), F.col("antecedent").alias("replacement")))


def resolve_clusters(docs: DataFrame, clusters: DataFrame, strict_reference: bool = False) -> DataFrame:
    """Adds ``resolved`` from mention clusters of any coreference model. clusters: (doc_id, cluster, start, end, text).

    A cluster's name is its shortest mention of up to four words with a capital first letter, else its longest one (ties:
    the first); pronouns are no names unless ``strict_reference``. Later spans win where spans overlap.
    """
    words = T.word_count(F.col("text"))
    proper = F.left(F.trim("text"), F.lit(1)).rlike(r"\p{Lu}") & (words <= 4)
    if not strict_reference:
        proper = proper & ~F.lower(F.trim("text")).isin(*T.PRONOUNS)
    c = clusters.withColumns({"_proper": proper, "_len": F.char_length("text")})
    main = c.groupBy("doc_id", "cluster").agg(
        F.min_by(F.when(F.col("_proper"), F.col("text")), F.when(F.col("_proper"), F.struct("_len", "start"))).alias("_short"),
        F.min_by("text", F.struct(-F.col("_len"), "start")).alias("_long"),
    )
    e = c.join(main, ["doc_id", "cluster"]).withColumn("replacement", F.coalesce("_short", "_long")).where(F.lower("text") != F.lower("replacement"))
    per = e.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "replacement")), False).alias("_e"))
    # from the right: a span is taken if it ends before the last one taken begins
    kind = "array<struct<start:int,end:int,replacement:string>>"
    per = per.withColumn("_e", F.col("_e").cast(kind))
    taken = F.aggregate("_e", F.array().cast(kind), lambda a, x: F.when((F.size(a) == 0) | (x["end"] <= F.element_at(a, -1)["start"]), F.concat(a, F.array(x))).otherwise(a))
    spans = per.select("doc_id", F.explode(taken).alias("_s")).select("doc_id", F.col("_s.start").alias("idx"), (F.col("_s.end") - F.col("_s.start")).alias("length"), "_s.replacement")
    return spliced(docs, spans)


# ---- pairs ----------------------------------------------------------------------------------------------------------------


def _pairs(ments: Column, gap_ok) -> Column:
    """All (a, b) mentions of a sentence, a before b in its list, that pass ``gap_ok`` (tokens between them)."""
    later = lambda k: F.slice(ments, k + 2, F.greatest(F.size(ments) - k - 1, F.lit(0)))
    return F.flatten(F.transform(ments, lambda a, k: F.transform(F.filter(later(k), lambda b: gap_ok(b["start"] - a["end"])), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def entity_pairs(sentences: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Candidate pairs: mentions of one sentence with 0 to ``max_entity_token_distance`` tokens between them."""
    most = cfg.max_entity_token_distance
    # a mention takes the tokens along that can stand between it and a later one: a pair's row has these, not the whole sentence's
    near = lambda m: F.transform(F.slice("tokens", m["end"] + 1, most), lambda t: F.struct(t["lemma"].alias("lemma"), (~t["is_stop"] & ~t["is_punct"]).alias("said")))
    s = _once(sentences.where(F.size("mentions") > 1).select("doc_id", "sent_id", "sentence", "tokens", "mentions"), _ms=F.transform("mentions", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), m["label"].alias("label"), near(m).alias("near"))))
    p = s.select("doc_id", "sent_id", "sentence", F.posexplode(_pairs(F.col("_ms"), lambda g: g.between(0, most))).alias("pair_idx", "_p"))
    inside = F.slice("_p.a.near", F.lit(1), F.greatest(F.col("_p.b.start") - F.col("_p.a.end"), F.lit(0)))
    context = F.array_join(F.transform(F.filter(inside, lambda t: t["said"]), lambda t: t["lemma"]), " ")
    return p.select(
        "doc_id", "sent_id", "pair_idx", F.lower("_p.a.text").alias("entity1"), F.col("_p.a.label").alias("type1"), F.lower("_p.b.text").alias("entity2"), F.col("_p.b.label").alias("type2"),
        context.alias("context"), "sentence", F.lit(cfg.conf_pair).alias("confidence"), F.col("_p.a.start").alias("start1"), F.col("_p.b.start").alias("start2"),
    )


# ---- dependency paths -------------------------------------------------------------------------------------------------------


def ancestors(toks: Column, start: Column, most: int) -> Column:
    """Token numbers from ``start`` up its heads, ``most`` nodes at most."""
    head = lambda i: F.get(toks, i)["head"]
    step = lambda c: F.when(head(F.element_at(c, -1)) == F.element_at(c, -1), c).otherwise(F.concat(c, F.array(head(F.element_at(c, -1)))))
    return F.aggregate(F.sequence(F.lit(2), F.lit(most)), F.array(start), lambda c, _: step(c))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once a row. (The optimizer would otherwise copy their expressions into every later use and
    filter; it doesn't look into a generator.)"""
    return df.select("*", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_once")).select("*", "_once.*").drop("_once")


def proposition_candidates(sentences: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """One row per mention pair whose heads are joined within the length limit.

    Columns: doc_id, sent_id, pair_idx, sentence, a, b (mentions), lemmas (content words on the path; none: evidence of no
    relation), negated, a_first (whether a is the subject side). A path longer than the limit, or none, is no evidence and
    gives no row, so chains need not be walked beyond the limit.
    """
    most = cfg.max_path_len + 2
    # a mention takes its chain of ancestors along: a pair's row has two chains, not the whole sentence's tokens
    tok = lambda i: F.get(F.col("tokens"), i)
    chain = lambda m: F.transform(ancestors(F.col("tokens"), m["root"], most), lambda i: F.struct(i.alias("i"), *[tok(i)[c].alias(c) for c in ("lemma", "pos", "dep")]))
    negations = F.transform(F.filter("tokens", lambda t: t["dep"] == "neg"), lambda t: F.struct(t["i"].alias("i"), t["head"].alias("head")))
    s = sentences.where(F.size("mentions") > 1).select("doc_id", "sent_id", "sentence", "tokens", "mentions")
    s = _once(s, _ms=F.transform("mentions", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m.alias("m"), chain(m).alias("chain"))), _neg=negations)
    p = s.select("doc_id", "sent_id", "sentence", "_neg", F.posexplode(_pairs(F.col("_ms"), lambda g: g <= cfg.max_entity_token_distance)).alias("pair_idx", "_p"))
    p = p.select("doc_id", "sent_id", "sentence", "_neg", "pair_idx", F.col("_p.a.m").alias("a"), F.col("_p.b.m").alias("b"), F.col("_p.a.chain").alias("_na"), F.col("_p.b.chain").alias("_nb"))
    # array_intersect keeps the order of its first list: b's nearest common ancestor
    p = _once(p, _lca=F.get(F.array_intersect("_nb.i", "_na.i"), F.lit(0))).where("_lca is not null")
    p = _once(p, _ka=F.array_position("_na.i", F.col("_lca")).cast("int"), _kb=F.array_position("_nb.i", F.col("_lca")).cast("int")).where(F.col("_ka") + F.col("_kb") - 1 <= most)
    down = F.slice("_nb", 1, F.col("_kb") - 1)
    p = _once(p, _path=F.concat(F.slice("_na", 1, F.col("_ka")), F.reverse(down)), _da=F.slice("_na.dep", 1, F.col("_ka") - 1), _db=F.slice("_nb.dep", 1, F.col("_kb") - 1))
    content = F.filter("_path", lambda n: (n["i"] != F.col("a.root")) & (n["i"] != F.col("b.root")) & n["pos"].isin(*cfg.path_content_pos))
    lemmas = F.transform(content, lambda n: F.lower(n["lemma"]))
    on_path = lambda i: F.array_contains(F.col("_path.i"), i)
    negated = F.exists("_neg", lambda t: on_path(t["i"]) | (on_path(t["head"]) & (t["head"] != t["i"])))
    p = _once(p, lemmas=lemmas, negated=negated)
    has = lambda c, labels: F.arrays_overlap(c, F.array(*map(F.lit, labels)))
    a, b = F.col("_da"), F.col("_db")
    first = (
        F.when(has(a, AGENT) | has(b, PASSIVE_SUBJECT), True)
        .when(has(b, AGENT) | has(a, PASSIVE_SUBJECT), False)
        .when(has(a, SUBJECT) & ~has(b, SUBJECT), True)
        .when(has(b, SUBJECT) & ~has(a, SUBJECT), False)
        .when(has(a, OBJECT) & ~has(b, OBJECT), False)
        .otherwise(True)
    )
    return p.select("doc_id", "sent_id", "pair_idx", "sentence", "a", "b", "lemmas", "negated", first.alias("a_first"))


def _named(rows: DataFrame, names: DataFrame | None, aliases: DataFrame | None) -> DataFrame:
    if names is None:
        return rows.withColumns({"_n1": T.normalize_surface(F.col("a.text")), "_n2": T.normalize_surface(F.col("b.text"))})
    rows = canonical(rows.withColumn("_s", F.col("a.text")), "_s", names, aliases, "_n1")
    return canonical(rows.withColumn("_s", F.col("b.text")), "_s", names, aliases, "_n2").drop("_s")


def propositions(found: DataFrame, names: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """(doc_id, sent_id, pair_idx, arg1, type1, arg2, type2, path, negated, sentence) from :func:`proposition_candidates`."""
    f = _named(found.where(F.size("lemmas") > 0), names, aliases)
    pick = lambda x, y: F.when(F.col("a_first"), x).otherwise(y)
    p = f.select("doc_id", "sent_id", "pair_idx", pick(F.col("_n1"), F.col("_n2")).alias("arg1"), pick(F.col("a.label"), F.col("b.label")).alias("type1"), pick(F.col("_n2"), F.col("_n1")).alias("arg2"), pick(F.col("b.label"), F.col("a.label")).alias("type2"), F.array_join("lemmas", ARROW).alias("path"), "negated", "sentence")
    return p.where("arg1 <> '' and arg2 <> '' and arg1 <> arg2")


def structural_negatives(found: DataFrame, names: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """(doc_id, lo, hi): unordered pairs of names joined by a short path without content words."""
    f = _named(found.where(F.size("lemmas") == 0), names, aliases).where("_n1 <> '' and _n2 <> '' and _n1 <> _n2")
    return f.select("doc_id", F.least("_n1", "_n2").alias("lo"), F.greatest("_n1", "_n2").alias("hi")).distinct()


def context_profiles(sentences: DataFrame) -> DataFrame:
    """(doc_id, entity, words): lemmas of the dependents of each mention's root that are no stop words, over all mentions in order.

    Dependents are found for all mentions of a batch at once, by their heads: a sentence with very many mentions costs no more than its
    tokens, where a search of all tokens for each mention would cost the product.
    """
    s = sentences.where(F.size("mentions") > 0)
    s = s.select("doc_id", "sent_id", F.col("mentions.text").alias("text"), F.col("mentions.root").alias("root"), *[F.col(f"tokens.{c}").alias(c) for c in ("i", "head", "is_stop", "lemma")])
    m = s.mapInArrow(_dependents, "doc_id string, sent_id int, ent_idx int, text string, words array<string>")
    m = m.select("doc_id", F.lower("text").alias("entity"), F.struct("sent_id", "ent_idx").alias("_at"), F.col("words").alias("_w"))
    return m.groupBy("doc_id", "entity").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_w"))), lambda x: x["_w"])).alias("words"), F.min("_at").alias("first"))


def _dependents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of :func:`context_profiles`, one for each mention: its words are the lemmas at the places whose head is its root."""
    for b in batches:
        for rows in (b.slice(k, 512) for k in range(0, b.num_rows, 512)):
            flat = {c: rows.column(c).flatten() for c in ("i", "head", "is_stop", "lemma", "text", "root")}
            lengths = lambda c: np.nan_to_num(pc.list_value_length(rows.column(c)).to_numpy(zero_copy_only=False)).astype(np.int64)
            n, k = lengths("i"), lengths("text")
            base = np.cumsum(n) - n  # where each sentence's tokens begin
            i, head, root = (pc.fill_null(flat[c], -1).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("i", "head", "root"))
            stop = pc.fill_null(flat["is_stop"], True).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(~stop & (i != head) & (head >= 0))
            to = head[at] + np.repeat(base, n)[at]
            order = np.argsort(to, kind="stable")  # by head, then place
            at, to = at[order], to[order]
            of = np.repeat(np.arange(len(k)), k)  # the sentence of each mention
            root = np.where(root < 0, -1, root + base[of])
            lo, hi = np.searchsorted(to, root, "left"), np.searchsorted(to, root, "right")
            ends = np.concatenate([[0], np.cumsum(hi - lo)])
            pick = np.arange(ends[-1]) + np.repeat(lo - ends[:-1], hi - lo)
            words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat["lemma"].take(pa.array(at[pick])))
            ent_idx = np.arange(len(of)) - np.repeat(np.cumsum(k) - k, k)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(of)), rows.column("sent_id").take(pa.array(of)), pa.array(ent_idx, pa.int32()), flat["text"], words], ["doc_id", "sent_id", "ent_idx", "text", "words"])


def pronoun_counts(before: DataFrame, after: DataFrame, words) -> DataFrame:
    """One row: pronouns before and after, resolved, and the rate. words: a column expression for a text's tokens (lower case)."""
    n = lambda df, c: df.agg(F.coalesce(F.sum(F.size(F.filter(words, lambda w: w.isin(*T.PRONOUNS)))), F.lit(0)).alias(c))
    j = n(before, "pronouns_before").crossJoin(n(after, "pronouns_after"))  # one row each
    done = F.greatest(F.col("pronouns_before") - F.col("pronouns_after"), F.lit(0))
    return j.withColumns({"pronouns_resolved": done, "resolution_rate": F.round(F.coalesce(F.try_divide(done, F.col("pronouns_before")), F.lit(0.0)), 3)})
