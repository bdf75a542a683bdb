"""DataFrame -> DataFrame operators, one module per stage of the dataset build:
graph, titles, curate, split, qa, score, stats, flatmap, plus shared building blocks in
common (keep_last, head_by, cut_lineage)."""
