"""Functions of terms and triples."""
