"""Compositions of the operators: dataset recipes, distillation, registered queries."""
