"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tessera.llm import fill_middle, personal, warc, whitening
from tessera.llm.decontam import leaks_of
from tessera.llm.graph_ann import nearest_of
from tessera.llm.line_dedup import lines_report_of
from tessera.llm.near_dup import near_duplicates
from tessera.llm.pieces import pieces_of
from tessera.llm.secrets import secrets_of
from tessera.llm.sharding import shard_documents
from tessera.llm.tables import load
from tessera.llm.token_files import token_files
from tessera.llm.toxicity import toxicity_of
from tessera.llm.warc import warc_pages

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_hyperminhash_near_dup(spark, sf_dir):
    """Components of documents whose 2-word shingle sets have a Jaccard similarity of 0.8 or more."""
    return near_duplicates(load(spark, sf_dir, "documents"), k=2, percent=80)


@query
def op3_stratified_shards(spark, sf_dir):
    """Eight shards of equal row counts, each with the mixture of sources."""
    return shard_documents(spark, sf_dir, shards=8)


@query
def op4_wavelet_token_files(spark, sf_dir):
    """Every document's place and ids as read back from the wavelet-matrix files."""
    return token_files(spark, sf_dir)


@query
def op5_ftrl_toxicity(spark, sf_dir):
    """Every document's toxicity score, held-out mark and decision."""
    return toxicity_of(spark, sf_dir)


@query
def op7_warc_archives(spark, sf_dir):
    """Every page's record as read back from the archives."""
    return warc_pages(spark, sf_dir)


ORACLES["op7_warc_archives"] = warc.ORACLE


@query
def op10_secret_scan(spark, sf_dir):
    """Counts and spans of secrets in every document."""
    return secrets_of(spark, sf_dir)


@query
def op2_sampled_pieces(spark, sf_dir):
    """Every document's sampled segmentation, and whether decoding it is lossless."""
    return pieces_of(spark, sf_dir)


@query
def op9_benchmark_leaks(spark, sf_dir):
    """Documents with a passage of a benchmark item, and the overlap."""
    return leaks_of(spark, sf_dir)


@query
def op8_fuzzy_lines(spark, sf_dir):
    """Every document's repeated lines: exact or nearly, all but the first occurrence of each group."""
    return lines_report_of(spark, sf_dir)


@query
def op6_pruned_graph_neighbours(spark, sf_dir):
    """The ten nearest vectors found for each query vector."""
    return nearest_of(spark, sf_dir)


@query
def pipeline(spark, sf_dir):
    """The stages of corpus_pipeline over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


@query
def op11_fill_in_middle(spark, sf_dir):
    """Every document cut and reordered for filling in the middle, and the text rebuilt from that."""
    return fill_middle.fill_middle_of(spark, sf_dir)


ORACLES["op11_fill_in_middle"] = fill_middle.ORACLE


@query
def op13_qd_whitening(spark, sf_dir):
    """Every usable vector on the whitened components of all of them."""
    return whitening.whitened_of(spark, sf_dir)


@query
def op12_personal_data(spark, sf_dir):
    """Counts and spans of personal data in every document."""
    return personal.personal_of(spark, sf_dir)
