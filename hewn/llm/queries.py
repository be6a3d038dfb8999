"""Queries of the training-data operators and their DuckDB counterparts; ``__spark_entry__`` adds them."""

from __future__ import annotations

from hewn.llm import diverse, doc_pairs, encode, handwritten, leaks, packing, rank_walk, sentences, split, vectors
from hewn.sources.tables import table


#: The configuration whose token budget the packs have, and the size of the varied subset.
PACK_CONFIG, SUBSET = 16, 500


def p1_choice(spark, d):
    return diverse.choose(table(spark, d, "code_embeddings"), table(spark, d, "chunks"), SUBSET)


def p2_found(spark, d):
    return vectors.similar_pairs(table(spark, d, "code_embeddings"), table(spark, d, "embedding_cache")).select("a_vec", "b_vec")


def p2_most_similar(spark, d):
    return vectors.most_similar(table(spark, d, "code_embeddings"), table(spark, d, "embedding_cache"))


def p3_method(spark, d):
    """The forest alone over all files: copied code reads like any other and files without chunks have no content, so it can't give all rows of p3_found."""
    return handwritten.forest_verdicts(table(spark, d, "chunks"))


def p3_found(spark, d):
    return handwritten.not_handwritten(table(spark, d, "chunks"), table(spark, d, "git_files"))


def p4_method(spark, d):
    """The merging alone over all chunks: it keeps only boundaries that it needs as cuts, so it can't give the start of every member."""
    return split.split_chunks(table(spark, d, "chunks")).drop("piece_text")


def p4_found(spark, d):
    return split.boundaries(table(spark, d, "chunks"))


def p4_pieces(spark, d):
    return split.split_chunks(table(spark, d, "chunks"))


def p5_found(spark, d):
    return doc_pairs.pairs(table(spark, d, "chunks"), with_code=False).select("row_id", "func_name")


def p5_pairs(spark, d):
    return doc_pairs.pairs(table(spark, d, "chunks"))


def p6_packs(spark, d):
    return packing.pack_chunks(table(spark, d, "chunks"), table(spark, d, "baseline_configs"), PACK_CONFIG)


def p7_files(spark, d):
    return rank_walk.file_ranks(table(spark, d, "git_files"))


def p7_runs(spark, d):
    return rank_walk.run_ranks(table(spark, d, "selection_results"))


def p8_ids(spark, d):
    return encode.encode_corpus(table(spark, d, "documents"))


def p9_found(spark, d):
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "qa_items")).select("doc_id", "item_id")


def p9_coverage(spark, d):
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "qa_items"))


def p10_found(spark, d):
    docs = table(spark, d, "documents").filter("doc_kind in ('design_note', 'review_thread', 'handbook')")
    return sentences.sentences(docs)


def p10_sentences(spark, d):
    return sentences.sentences(table(spark, d, "documents"), with_text=True)


QUERIES = {
    k: v
    for k, v in list(globals().items())
    if k[:1] == "p" and k[1:2].isdigit()
}
ORACLE_SQL: dict[str, str] = {}
