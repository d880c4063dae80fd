"""Chains of operators, as the command line of a points toolbox would run them."""
