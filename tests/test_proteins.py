"""Real proteins: one query and 25 targets, with known results. The values are fixed values."""

import csv
import gzip
import io
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from protloom import cli
from protloom.functions.hashing import unsigned_text
from protloom.index import ProteinIndex, SequenceSet
from protloom.operators import kmers as km
from protloom.operators import search as se
from protloom.operators import stitch as st
from protloom.sources import fasta as fa

DATA = Path(__file__).resolve().parent / "data"
QUERY = "sp|P41958|CED9_CAEEL Apoptosis regulator ced-9 OS=Caenorhabditis elegans OX=6239 GN=ced-9 PE=1 SV=1"
BNIP2 = "sp|Q12982|BNIP2_HUMAN BCL2/adenovirus E1B 19 kDa protein-interacting protein 2 OS=Homo sapiens OX=9606 GN=BNIP2 PE=1 SV=1"
ASPP2 = "sp|Q13625|ASPP2_HUMAN Apoptosis-stimulating of p53 protein 2 OS=Homo sapiens OX=9606 GN=TP53BP2 PE=1 SV=2"
BAK = "sp|Q16611|BAK_HUMAN Bcl-2 homologous antagonist/killer OS=Homo sapiens OX=9606 GN=BAK1 PE=1 SV=1"
BBC3 = "sp|Q9BXH1|BBC3_HUMAN Bcl-2-binding component 3, isoforms 1/2 OS=Homo sapiens OX=9606 GN=BBC3 PE=1 SV=1"
FBX10 = "sp|Q9UK96|FBX10_HUMAN F-box only protein 10 OS=Homo sapiens OX=9606 GN=FBXO10 PE=1 SV=3"
QUERY_MD5 = "fe3714626e8180caf90f78091563aae6"

# match: containment, intersect_hashes, match_md5, jaccard, max_containment, the four identities, n_weighted_found, total_weighted_hashes, containment_target_in_query, f_weighted_target_in_query
MANY = {
    BNIP2: (0.04081632653061224, 2, "7bbc6e2ea3a472034fc31321943032ee", 0.02040816326530612, 0.04081632653061224, 0.9355328459682174, 0.934753456124389, 0.9351431510463032, 0.9355328459682174, 2, 51, 0.0392156862745098, 0.0392156862745098),
    ASPP2: (0.02040816326530612, 1, "35da5dcf3561c6c0b0aaa34a118eabef", 0.0036101083032490976, 0.02040816326530612, 0.9221202973899911, 0.8929697781452893, 0.9075450377676402, 0.9221202973899911, 1, 230, 0.004366812227074236, 0.004347826086956522),
    BAK: (0.02040816326530612, 1, "1f59cdb10b02a7c6baff18b034518599", 0.011111111111111112, 0.023809523809523808, 0.9221202973899911, 0.9250864216273635, 0.9236033595086773, 0.9250864216273635, 1, 42, 0.023809523809523808, 0.023809523809523808),
    BBC3: (0.04081632653061224, 2, "1d49aa1205276b9ba0176c6680cacd6d", 0.024390243902439025, 0.05714285714285714, 0.9355328459682174, 0.9421138187376149, 0.9388233323529162, 0.9421138187376149, 2, 35, 0.05714285714285714, 0.05714285714285714),
    FBX10: (0.061224489795918366, 3, "97f5f83c6214d6792113785b96747383", 0.014354066985645933, 0.061224489795918366, 0.9434689410983454, 0.9201376138657374, 0.9318032774820415, 0.9434689410983454, 3, 164, 0.018404907975460124, 0.018292682926829267),
}
# match: prob_overlap, prob_overlap_adjusted, containment_adjusted, containment_adjusted_log10, tf_idf_score
MULTI = {
    BNIP2: (0.000023191094619666044, 0.0005797773654916511, 70.4, 1.8475726591421122, 0.1455081370392464),
    ASPP2: (0.000011595547309833022, 0.00028988868274582556, 70.4, 1.8475726591421122, 0.0727540685196232),
    BAK: (0.000011595547309833022, 0.00028988868274582556, 70.4, 1.8475726591421122, 0.0727540685196232),
    BBC3: (0.000023191094619666044, 0.0005797773654916511, 70.4, 1.8475726591421122, 0.1455081370392464),
    FBX10: (0.00003478664192949907, 0.0008696660482374767, 70.4, 1.8475726591421122, 0.2182622055588696),
}
# match: query_start, query_end, query, match_start, match_end, match, encoded, length
STITCHED = {
    BNIP2: (76, 108, "RLDIEGFVVDYFTHRILFVYTSLFIKTRIRNN", 23, 55, "SIEADILAITGPEDQPLLAVTRPFISSKFSQK", "phphphhhhphhppphhhhhpphhhppphppp", 32),
    ASPP2: (241, 257, "KVGRRKQNRRWSMIGA", 1084, 1100, "TIIHREDEDEIEWWWA", "phhppppppphphhhh", 16),
    BAK: (245, 261, "RKQNRRWSMIGAGVTA", 42, 58, "HQQEQEAEGVAAPADP", "pppppphphhhhhhph", 16),
    BBC3: (170, 187, "LIGLISFGGFVAAKMME", 46, 63, "APAAPTLLPAAYLCAPT", "hhhhhphhhhhhhphhp", 17),
    FBX10: (59, 92, "MSIGESIDGKINDWEEPGIVGVVVCGRMMFSLK", 57, 90, "PNWPNQPDVEPESWREAAGIYILYHGNPVVSGN", "hphhpphphphpphpphhhhhhhhphphhhphp", 33),
}
SHOWN = [
    f"\n---\nQuery Name: {QUERY}\nMatch Name: {m}\nquery: {STITCHED[m][2]} ({STITCHED[m][0]}-{STITCHED[m][1]})\nalpha: {STITCHED[m][6]}\nmatch: {STITCHED[m][5]} ({STITCHED[m][3]}-{STITCHED[m][4]})"
    for m in (FBX10, BNIP2, BBC3, ASPP2, BAK)
]
MEASURES = ("containment", "intersect_hashes", "match_md5", "jaccard", "max_containment", "query_containment_ani", "match_containment_ani", "average_containment_ani", "max_containment_ani", "n_weighted_found", "total_weighted_hashes", "containment_target_in_query", "f_weighted_target_in_query")


def near(got, want):
    assert got == tuple(pytest.approx(x, rel=1e-12) if isinstance(x, float) else x for x in want)


def sequences(spark, name):
    return fa.read_fasta(spark, str(DATA / f"{name}.fasta"))


@pytest.fixture
def files(tmp_path):
    """The query as it is, the targets compressed."""
    query, targets = tmp_path / "query.fasta", tmp_path / "targets.fasta.gz"
    query.write_bytes((DATA / "query.fasta").read_bytes())
    targets.write_bytes(gzip.compress((DATA / "targets.fasta").read_bytes()))
    return str(query), str(targets)


def test_the_files(spark):
    targets = sequences(spark, "targets")
    assert targets.count() == 25 and targets.agg(F.sum(F.length("sequence"))).first()[0] == 9288
    (query,) = sequences(spark, "query").collect()
    assert query["name"] == QUERY and len(query["sequence"]) == 280


@pytest.mark.parametrize("reduced", [False, True])
def test_measures(spark, reduced):
    queries = se.read_collection(sequences(spark, "query"), 16, "hp", 5)
    targets = se.read_collection(sequences(spark, "targets"), 16, "hp", 5, only=queries.known() if reduced else None)
    rows = {r["match_name"]: r for r in se.manysearch(queries, targets, 16, 5, "hp").collect()}
    assert set(rows) == set(MANY)
    for name, want in MANY.items():
        r = rows[name]
        near(tuple(r[c] for c in MEASURES), want)
        assert (r["query_name"], r["query_md5"], r["ksize"], r["scaled"], r["moltype"]) == (QUERY, QUERY_MD5, 48, 5, "hp")
        assert (r["average_abund"], r["median_abund"], r["std_abund"]) == (1.0, 1.0, 0.0)
    many = {r["match_name"]: r for r in se.multisearch(queries, targets, 16, 5, "hp").collect()}
    assert set(many) == set(MULTI)
    for name, want in MULTI.items():
        r, m = many[name], MANY[name]
        near(tuple(r[c] for c in ("prob_overlap", "prob_overlap_adjusted", "containment_adjusted", "containment_adjusted_log10", "tf_idf_score")), want)
        near(tuple(r[c] for c in ("containment", "max_containment", "jaccard", "intersect_hashes", "match_md5", "query_md5")), (m[0], m[4], m[3], float(m[1]), m[2], QUERY_MD5))


def test_stitched(spark):
    own = {name: km.kmer_positions(sequences(spark, name), 16, "hp", 5) for name in ("query", "targets")}
    rows = st.shown(st.stitch(se.kmer_hits(own["query"], own["targets"]))).collect()
    got = {r["match_name"]: tuple(r[c] for c in ("query_start", "query_end", "query", "match_start", "match_end", "match", "encoded", "length")) for r in rows}
    assert got == STITCHED and sorted(r["to_print"] for r in rows) == sorted(SHOWN)


def test_search_command(spark, files, capsys, tmp_path):
    assert cli.main(["search", "--ksize", "16", *files]) == 0
    rows = list(csv.DictReader(io.StringIO(capsys.readouterr().out)))
    assert [r["match_name"] for r in rows] == sorted(MANY)
    for r in rows:
        near(tuple(type(w)(r[c]) for c, w in zip(MEASURES, MANY[r["match_name"]], strict=True)), MANY[r["match_name"]])
    assert (tmp_path / "query.fasta.hp.k16.scaled5.sketch").exists() and (tmp_path / "targets.fasta.gz.hp.k16.scaled5.sketch").exists()
    # stitched, from the sketches just made, and from a stored index
    index = str(tmp_path / "index")
    assert cli.main(["index", "-i", files[1], "-o", index, "-k", "16", "-s", "5", "-e", "hp"]) == 0
    capsys.readouterr()
    for target in (files[1], index):
        assert cli.main(["search", "--extract-kmers", "--ksize", "16", files[0], target]) == 0
        said = capsys.readouterr()
        rows = list(csv.reader(io.StringIO(said.out)))
        assert rows[0] == ["match_name", "query_name", "query_start", "query_end", "query", "match_start", "match_end", "match", "encoded", "length"]
        assert {r[0]: (r[1], tuple(r[2:])) for r in rows[1:]} == {m: (QUERY, tuple(map(str, w))) for m, w in STITCHED.items()}
        assert "\n".join(SHOWN) in said.err


@pytest.mark.parametrize(("moltype", "k", "scaled", "combined", "occurrences", "digests"), [
    ("protein", 5, 1, 9049, 9188, {"4d565dee9c8de9db": 474, "4da1f84ad8be618e": 235}),
    ("dayhoff", 5, 1, 2730, 9188, {"fc27dcd533217385": 433, "3206706fa14185e7": 204}),
    ("hp", 12, 1, 3549, 9013, {"38ffedf9d3ec7cec": 452, "204716e4d80eb350": 220}),
    ("hp", 16, 5, 1603, 1760, {}),
])
def test_index_of_the_targets(spark, tmp_path, files, moltype, k, scaled, combined, occurrences, digests):
    own = ProteinIndex(spark, str(tmp_path / "i"), k, scaled, moltype)
    own.process_fasta(files[1])
    again = ProteinIndex.load(spark, own.path)
    assert (again.signature_count(), again.combined_size()) == (25, combined)
    assert again.combined().agg(F.sum("abund")).first()[0] == occurrences
    rows = {r["pseudo_md5"]: r["n_hashes"] for r in again.signatures().collect()}
    assert len(rows) == 25 and digests.items() <= rows.items()


def test_extracted_kmers(spark, files):
    own = SequenceSet(spark, files[1], 24, 5, "hp", extract_kmers=True)
    export = own.kmer_export()
    assert export.count() == 1712 and export.columns == ["sequence_file", "sequence_name", "kmer", "hashval", "encoded", "start"]
    assert own.sketch().select(unsigned_text(F.col("hashval"))).distinct().count() == 1705
    assert own.kmers().where("length(kmer) <> 24 OR length(encoded) <> 24").count() == 0
