"""Column expressions: text, links, periods, vectors, metrics of one record; also as SQL functions."""
