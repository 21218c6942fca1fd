"""quarrymill.operators"""
