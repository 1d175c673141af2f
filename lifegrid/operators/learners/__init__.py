"""Survival learners on bounded encoded matrices; fits run inside tasks."""
