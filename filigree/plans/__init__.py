"""Plans: embedding, graph grammars, the search for a graph, and the queries built on them."""
