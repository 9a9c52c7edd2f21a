"""papyra.operators"""
