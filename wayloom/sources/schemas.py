"""Schemas of the stored tables."""

WAYS = "way_id long, node_ids array<long>, tags map<string,string>"
NODES = "osm_id long, lat double, lon double, tags map<string,string>"
EDGES = "src long, dst long, weight double, mode int, mid_node long, metres double, highway string, way_id long, pos int"
RANKS = "node long, rank int"
PLACES = "id long, osm_id long, name string, name_vi string, name_norm string, type string, lat double, lon double"
RANGES = "id long, street string, street_norm string, num_start int, num_end int, lat_start double, lon_start double, lat_end double, lon_end double, interp_type string"
TILES = "tile_size double, ty long, tx long, src long, dst long, lat_src double, lon_src double, lat_dst double, lon_dst double"
BLOCKS = "tile_size double, ty long, tx long, ends binary"
REQUESTS = "req_id long, lat_a double, lon_a double, lat_b double, lon_b double, mode int"
TABLES = {"ways": WAYS, "nodes": NODES, "edges": EDGES, "ranks": RANKS, "places": PLACES, "addr_ranges": RANGES, "requests": REQUESTS, "tiles": TILES, "blocks": BLOCKS, "shortcuts": EDGES}
