"""What runs end to end: data sets, experiments and the registered queries."""
