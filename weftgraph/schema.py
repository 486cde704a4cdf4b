"""Schemas of the tables that operators pass on."""

ARTICLES = "article_seq long, pmid string, date string, journal string, doi string, title string, abstract string, volume string, issue string, pages string, authors array<string>, citation_count int, use_vocab boolean"
MENTIONS = "article_seq long, mention_seq int, pmid string, start int, end int, name string, identifier_name string, type string, mesh string"
RELATIONS = "article_seq long, rel_seq int, pmid string, relation_type string, id1 string, name1 string, id2 string, name2 string"
ANNOTATION_TYPES = ["Chemical", "Gene", "miRNA", "Species", "Disease", "DNAMutation", "ProteinMutation", "CellLine", "SNP"]  # fixed values
# What types look like.
COLORS = {"Chemical": "#67A9CF", "Gene": "#74C476", "Species": "#FD8D3C", "Disease": "#8C96C6", "DNAMutation": "#FCCDE5", "ProteinMutation": "#FA9FB5", "CellLine": "#BDBDBD", "SNP": "#FFFFB3"}
SHAPES = {"Chemical": "ELLIPSE", "Gene": "TRIANGLE", "Species": "DIAMOND", "Disease": "ROUNDRECTANGLE", "DNAMutation": "PARALLELOGRAM", "ProteinMutation": "HEXAGON", "CellLine": "VEE", "SNP": "OCTAGON"}
DEFAULT_COLOR, DEFAULT_SHAPE = "#888888", "ELLIPSE"
