"""Training-data operators.  Nothing else in askwright imports this subpackage."""
