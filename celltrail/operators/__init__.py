"""Library of DataFrame operators."""
