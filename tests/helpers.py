"""Small synthetic graphs: edges between forward nodes of length 10, coverage 5, k = 7."""

from strandflow.operators.graph import AssemblyGraph
from strandflow.operators.walkers import LocalGraph


def local(edges: str, k: int = 7, length: int = 10, coverage: float = 5.0) -> LocalGraph:
    arcs = [(int(e[0]), int(e[1])) for e in edges.split()]
    ids = sorted({n for a in arcs for n in a})
    return LocalGraph.of(k, [(n, length, coverage) for n in ids], arcs)


def graph(spark, edges: str, k: int = 7, lengths=None, cov_sums=None, noded_reads=None) -> AssemblyGraph:
    arcs = [(int(e[0]), int(e[1])) for e in edges.split()]
    ids = sorted({n for a in arcs for n in a})
    size = lambda n: (lengths or {}).get(n, 10)
    nodes = spark.createDataFrame(
        [(n, size(n), (cov_sums or {}).get(n, 5), "A" * size(n), "T" * size(n)) for n in ids], "node_id int, length int, cov_sum long, ends_fwd string, ends_twin string"
    )
    a = spark.createDataFrame([(x, True, y, True, 1) for x, y in arcs], "begin_id int, begin_fwd boolean, end_id int, end_fwd boolean, mult long")
    placed = None
    if noded_reads is not None:
        placed = spark.createDataFrame([(n, r, 0, 0, f) for n, r, f in noded_reads], "node_id int, read_id int, offset int, start_coord int, fwd boolean")
    return AssemblyGraph(nodes, a, k, placed)


def paths(found) -> list[str]:
    return sorted("".join(str(n) for n in p) for p in found)
