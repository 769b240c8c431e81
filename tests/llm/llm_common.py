SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, tk string, hits int, block int"


def rows(df, *columns):
    """Rows as tuples, in a fixed order."""
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)
