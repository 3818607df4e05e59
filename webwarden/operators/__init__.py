"""webwarden.operators"""
