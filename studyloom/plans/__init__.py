"""Study jobs. Inputs are conformed listings, outputs unsorted tables unless small."""
