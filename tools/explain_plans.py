"""Print the formatted physical plan of selected registered queries."""

import sys

sys.path.insert(0, ".")


def main():
    from quire.plans.registry import queries
    from quire.session import local_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or ["build_chunks", "knn_centroids", "bm25", "index_sync", "match_rules", "prompts"]
    spark = local_session(8)
    for n in names:
        df = queries()[n](spark, sf)
        print(f"==== {n}")
        df.explain("formatted")


if __name__ == "__main__":
    main()
