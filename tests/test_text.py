import pytest
from pyspark.sql import functions as F

from relata.config import Config
from relata.functions import text as T
from relata.operators import text as X
from relata.sources.annotate import from_token_table, load_spacy, shape_sentences, with_parser

TOKENS = "doc_id string, sent_id int, i int, idx int, text string, lemma string, pos string, dep string, head int, is_stop boolean, is_punct boolean"
MENTIONS = "doc_id string, sent_id int, start int, end int, root int, text string, label string"


def tree(spark, words, mentions, doc="d"):
    """words: (text, pos, dep, head); mentions: (start, end, root, label). idx counts with one blank between words."""
    toks, at = [], 0
    for i, (w, pos, dep, head) in enumerate(words):
        toks.append((doc, 0, i, at, w, w.lower(), pos, dep, head, w.lower() in ("was", "by", "the"), not w[0].isalnum()))
        at += len(w) + 1
    ments = [(doc, 0, s, e, r, " ".join(w[0] for w in words[s:e]), label) for s, e, r, label in mentions]
    return from_token_table(spark.createDataFrame(toks, TOKENS), spark.createDataFrame(ments, MENTIONS))


def props(spark, words, mentions, cfg=Config()):
    found = X.proposition_candidates(tree(spark, words, mentions), cfg)
    return [(r.arg1, r.path, r.arg2, r.negated) for r in X.propositions(found).collect()], [(r.lo, r.hi) for r in X.structural_negatives(found).collect()]


ADA, BOB = (0, 1, 0, "PERSON"), (2, 3, 2, "PERSON")


def test_active_voice(spark):
    assert props(spark, [("Ada", "PROPN", "nsubj", 1), ("Met", "VERB", "ROOT", 1), ("Bob", "PROPN", "dobj", 1)], [ADA, BOB]) == ([("ada", "met", "bob", False)], [])


def test_passive_voice_with_agent_turns_the_arguments(spark):
    words = [("Ada", "PROPN", "nsubjpass", 2), ("was", "AUX", "auxpass", 2), ("hired", "VERB", "ROOT", 2), ("by", "ADP", "agent", 2), ("Bob", "PROPN", "pobj", 3)]
    assert props(spark, words, [ADA, (4, 5, 4, "PERSON")])[0] == [("bob", "hired→by", "ada", False)]


def test_passive_voice_without_agent(spark):
    words = [("Ada", "PROPN", "nsubjpass", 2), ("was", "AUX", "auxpass", 2), ("born", "VERB", "ROOT", 2), ("in", "ADP", "prep", 2), ("Rome", "PROPN", "pobj", 3)]
    assert props(spark, words, [ADA, (4, 5, 4, "GPE")])[0] == [("rome", "born→in", "ada", False)]


def test_two_objects_keep_their_order(spark):
    words = [("gave", "VERB", "ROOT", 0), ("Ada", "PROPN", "dobj", 0), ("Bob", "PROPN", "iobj", 0)]
    assert props(spark, words, [(1, 2, 1, "PERSON"), (2, 3, 2, "PERSON")])[0] == [("ada", "gave", "bob", False)]


def test_negation_by_a_child_of_the_path(spark):
    words = [("Ada", "PROPN", "nsubj", 2), ("not", "PART", "neg", 2), ("met", "VERB", "ROOT", 2), ("Bob", "PROPN", "dobj", 2)]
    assert props(spark, words, [ADA, (3, 4, 3, "PERSON")])[0] == [("ada", "met", "bob", True)]


def test_path_without_content_is_a_structural_negative(spark):
    words = [("Ada", "PROPN", "conj", 1), ("and", "CCONJ", "ROOT", 1), ("Bob", "PROPN", "conj", 1)]
    assert props(spark, words, [ADA, BOB]) == ([], [("ada", "bob")])


def test_length_limit_and_disconnected_heads_are_no_evidence(spark):
    chain = [("Ada", "PROPN", "nsubj", 1), *[(f"w{i}", "VERB", "x", i + 1) for i in range(1, 7)], ("Bob", "PROPN", "ROOT", 7)]
    assert props(spark, chain, [ADA, (7, 8, 7, "PERSON")]) == ([], [])  # 8 nodes
    assert len(props(spark, chain, [ADA, (7, 8, 7, "PERSON")], Config(max_path_len=6))[0]) == 1
    apart = [("Ada", "PROPN", "ROOT", 0), ("and", "CCONJ", "cc", 0), ("Bob", "PROPN", "ROOT", 2)]
    assert props(spark, apart, [ADA, BOB]) == ([], [])


def test_equal_names_give_nothing(spark):
    words = [("A.B.", "PROPN", "nsubj", 1), ("met", "VERB", "ROOT", 1), ("AB", "PROPN", "dobj", 1)]
    assert props(spark, words, [ADA, BOB]) == ([], [])


def test_pairs_and_context(spark):
    words = [("Ada", "PROPN", "nsubj", 1), ("met", "VERB", "ROOT", 1), ("the", "DET", "det", 3), ("king", "NOUN", "dobj", 1), (",", "PUNCT", "punct", 1), ("Bob", "PROPN", "appos", 3)]
    s = tree(spark, words, [ADA, (5, 6, 5, "PERSON")])
    assert [(r.entity1, r.entity2, r.context) for r in X.entity_pairs(s).collect()] == [("ada", "bob", "met king")]
    assert X.entity_pairs(s, Config(max_entity_token_distance=3)).count() == 0


def test_context_profiles(spark):
    words = [("old", "ADJ", "amod", 1), ("Ada", "PROPN", "nsubj", 2), ("met", "VERB", "ROOT", 2), ("the", "DET", "det", 4), ("Bob", "PROPN", "dobj", 2), ("today", "NOUN", "npadvmod", 4)]
    s = tree(spark, words, [(1, 2, 1, "PERSON"), (4, 5, 4, "PERSON")])
    assert {r.entity: r.words for r in X.context_profiles(s).collect()} == {"ada": ["old"], "bob": ["today"]}


def test_pronouns_follow_the_last_entity_of_their_kind(spark):
    words = [("It", "PRON", "x", 0), ("Ada", "PROPN", "x", 0), ("met", "VERB", "x", 0), ("Acme", "PROPN", "x", 0), ("She", "PRON", "x", 0), ("liked", "VERB", "x", 0), ("it", "PRON", "x", 0), ("and", "CCONJ", "x", 0), ("her", "PRON", "x", 0), ("desk", "NOUN", "x", 0), ("They", "PRON", "x", 0)]
    s = tree(spark, words, [(1, 2, 1, "PERSON"), (3, 4, 3, "ORG")])
    docs = spark.createDataFrame([("d", " ".join(w[0] for w in words)), ("e", None)], "doc_id string, text string")
    out = {r.doc_id: r.resolved for r in X.resolve_pronouns(docs, X.tokens(s), X.mentions(s)).collect()}
    assert out == {"d": "It Ada met Acme Ada liked Acme and Ada desk Ada", "e": ""}


def test_clusters_name_mentions_and_skip_overlaps(spark):
    text = "He said Ada Lovelace wrote. The countess slept."
    c = [("d", 0, 0, 2, "He"), ("d", 0, 8, 20, "Ada Lovelace"), ("d", 0, 28, 40, "The countess"), ("d", 1, 32, 40, "countess"), ("d", 1, 8, 11, "Ada")]
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string")
    clusters = spark.createDataFrame(c, "doc_id string, cluster int, start int, end int, text string")
    assert X.resolve_clusters(docs, clusters).first().resolved == "Ada Lovelace said Ada Lovelace wrote. The Ada slept."
    assert X.resolve_clusters(docs, clusters.where("cluster = 0"), strict_reference=True).first().resolved == "He said He wrote. He slept."


def test_glosses_in_both_orders_and_greedy_capture(spark):
    docs = spark.createDataFrame([("a", "He joined General Electric (GE). GE (Gen Elec) grew."), ("b", "the World Bank (W.B.) met"), ("c", None)], "doc_id string, text string")
    got = {(r.doc_id, r.alias): r.canonical for r in X.glosses(docs).collect()}
    assert got == {("a", "ge"): "gen elec", ("b", "wb"): "world bank"}
    first = docs.where("doc_id = 'a'").withColumn("text", F.lit("He joined General Electric (GE)."))
    assert X.glosses(first).first().canonical == "he joined general electric"


def test_initials_never_override_a_gloss_and_aliases_win(spark):
    m = spark.createDataFrame([("d", 0, 0, "General Electric", "ORG"), ("d", 0, 1, "GE", "ORG"), ("d", 1, 0, "G.E.", "ORG"), ("d", 1, 1, "IBM", "ORG"), ("d", 2, 0, "Ada", "PERSON")], "doc_id string, sent_id int, ent_idx int, text string, label string")
    assert [(r.alias, r.canonical) for r in X.initial_glosses(m).collect()] == [("ge", "general electric")]
    docs = spark.createDataFrame([("d", "the Great Estate (GE) and more")], "doc_id string, text string")
    names = X.name_map(docs, m)
    assert [(r.alias, r.canonical) for r in names.collect()] == [("ge", "great estate")]
    alias = spark.createDataFrame([("I.B.M.", " International Business Machines ")], "alias string, canonical string")
    assert sorted(r.c for r in X.canonical(m, "text", names, alias, "c").collect()) == ["ada", "general electric", "great estate", "great estate", "international business machines"]


def test_normal_forms(spark):
    df = spark.createDataFrame([(" U.S.\u00a0 Steel’s ",), (None,), ("",)], "s string")
    assert [r[0] for r in df.select(T.normalize_surface(F.col("s"))).collect()] == ["us steel's", "", ""]
    paths = spark.createDataFrame([("take→job-with",), ("→",), ("é",), ("x" * 60,)], "p string")
    assert [r[0] for r in paths.select(T.readable_label(F.col("p"))).collect()] == ["TAKE_JOBWITH", "_", "RELATED_TO", "X" * 40]
    j = spark.createDataFrame([("a b", "B  c", 1 / 3), ("", None, 1.0), ("a", "", 0.0)], "a string, b string, want double")
    for r in j.select(T.token_jaccard(F.col("a"), F.col("b")).alias("j"), "want").collect():
        assert r.j == pytest.approx(r.want)


def test_concepts(spark):
    m = spark.createDataFrame([("d", 0, 0, "Ada", "PERSON", "ada"), ("d", 1, 0, "ADA", "ORG", "ada")], "doc_id string, sent_id int, start int, text string, label string, canonical string")
    c = spark.createDataFrame([("d", 0, 2, "big engines", "big engine"), ("d", 0, 5, "engines", "engine"), ("d", 0, 0, "Ada", "ada")], "doc_id string, sent_id int, start int, text string, lemma string")
    got = {(r.concept, r.type, r.surface, r.confidence, tuple(r.sources)) for r in X.concepts(m, c).collect()}
    assert got == {("ada", "PERSON", "Ada", 0.9, ("NER",)), ("big engine", "CONCEPT", "big engines", 0.6, ("NOUN_CHUNK",))}


def test_shape_annotator_and_parser_plug_in(spark):
    docs = spark.createDataFrame([(1, "The magnificent of dedicated. x"), (2, None)], "doc_id long, text string")
    s = {(r.doc_id, r.sent_id): r for r in shape_sentences(docs).collect()}
    assert sorted(s) == [("1", 0), ("1", 1)]
    first = s["1", 0]
    assert [t.pos for t in first.tokens] == ["DET", "NOUN", "DET", "NOUN"] and [(m.start, m.label) for m in first.mentions] == [(1, "SHORT"), (3, "SHORT")]

    def load():
        def parse(text):
            return [dict(sentence=text, tokens=[], mentions=[], chunks=[])] if text else []

        return parse

    assert with_parser(docs, load).count() == 1
    with pytest.raises(RuntimeError):
        load_spacy()()


def test_pronoun_counts(spark):
    a = spark.createDataFrame([("he met her",), ("it",)], "text string")
    b = spark.createDataFrame([("ada met ada",), ("it",)], "text string")
    r = X.pronoun_counts(a, b, F.split("text", " ")).first()
    assert (r.pronouns_before, r.pronouns_after, r.pronouns_resolved, r.resolution_rate) == (3, 1, 2, 0.667)
