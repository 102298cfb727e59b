"""Column helpers and scalar functions: state masks, intervals, alphabets, IUPAC codes, text."""
