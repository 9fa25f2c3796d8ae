"""Where facts come from and where graphs, vectors and predictions go."""
