"""Schemas of the engine's tables, as DDL."""

TILES = "tile_idx long, tile_id string, image string, cx double, cy double, ew double, eh double, metadata string"
QUERIES = "query_idx long, query_id string, image string, gt_tile_id string, dx double, dy double, x double, y double, positives array<string>"
POSITIVES = "query_idx long, tile_idx long"
PATCHES = "image_idx long, p long, row long, col long, desc array<double>"
MASKS = "image_idx long, seg long, p long"
CENTERS = "k long, c array<double>"
RANKING = "query_id long, rank long, db_id long, sim double"
SCORE_MAP = "query_idx long, tile_idx long, tp long, v double"
