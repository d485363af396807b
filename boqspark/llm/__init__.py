"""Training-data operators: tokenising, chat rendering, filtering, scoring, matching, packing, search."""
