"""Schemas of the tidy tables that operators take and return."""

SEQUENCE = "aln_id string, seq_idx int, seq_id string, seq string, is_query boolean"
RESIDUE = "seq_idx bigint, pos int, code int"
FREQUENCY = "node string, pos_i int, pos_j int, c1 int, c2 int, cnt bigint"
DISTANCE = "i bigint, j bigint, d double"
TREE_NODE = "node string, parent string, inner_no int, is_leaf boolean, branch_length double"
ATOM = "chain string, resno int, resname string, atom_name string, x double, y double, z double"
SCORE = "pos_i int, pos_j int, score double, rank int, coverage double"
EVALUATION_PAIR = "pos_i int, pos_j int, separation int, category string, distance double, contact boolean"
