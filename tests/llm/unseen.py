"""Labelled sentences of kinds that the labelled table doesn't have, with names, streets and hosts of other stocks."""

import random

GIVEN = "Valdirene Osvaldo Thiago Priscila Nivaldo Rosângela Emerson Cleusa Everton Marlene Jonas Sabrina Ubiratan Ivete Douglas Zilda Alan Noemi Reinaldo Tatiana".split()
LAST = "Albuquerque Brandão Cavalcanti Dantas Esteves Figueiredo Guimarães Holanda Junqueira Lacerda Medeiros Nogueira Prado Queiroz Ramalho Sampaio Tavares Uchoa Vasconcelos Xavier Zimmermann Fontoura Okamoto Petrov Andreatta".split()
STREETS = ["Rua Marechal Deodoro, 55", "Avenida Paulista, 1578", "Rua dos Inconfidentes, 867", "Travessa Frei Caneca, 12", "Praça Tiradentes, s/n", "Rua Augusta, 2203, apto 41", "Rodovia Raposo Tavares, km 22", "Estrada Velha do Campinho, 300", "Rua Ouro Preto 77", "Avenida Getúlio Vargas, nº 1200"]
HOSTS = ["gmail.example", "clinica-vida.example.org", "empresa.com.test", "uni.edu.invalid"]
FRAMES = (
    "O gerente {name} deixou recado ontem à tarde.", "Quem atendeu foi {name}, que pediu para ligar no {phone}.", "Contrato firmado entre {name} e {name}, ambos maiores.", "Encontrei {name} na saída do banco.",
    "Moro na {address} desde pequeno.", "Mudamos para a {address} no ano passado.", "Meu CPF é {cpf} e minha identidade é RG {rg}.", "CPF do comprador: {cpf}", "Para confirmar, responda a {email} ainda hoje.", "Qualquer dúvida escreva para {email} ou ligue {phone}.",
    "Vendedor: {name}. Comprador: {name}.", "A professora {name} elogiou a turma.", "Recebido de {name} a quantia de R$ 350,00 referente ao aluguel.", "O corpo de {name} será velado na capela municipal.", "Procurador: {name}, inscrito no CPF {cpf}.", "Ficha de {name}, PIS {pis}, admissão em 03/02/2019.",
    "O imóvel fica na {address}, perto da escola.", "Favor entregar na {address} até as 18h.", "WhatsApp: {phone}", "Ligar no {phone} em horário comercial.", "Autor do livro: {name}", "Obrigado, {name}, pelo envio dos papéis.", "A vítima, {name}, foi levada ao pronto-socorro.", "Segundo {name}, o carro vinha em alta velocidade.",
    "A reunião começa às 14h30 na sala 12 do segundo andar.", "O pedido 4458 foi entregue em 12/08/2020 pela transportadora.", "A Lei nº 8.078 trata da defesa do consumidor.", "Comprei três caixas de parafusos e duas latas de tinta.", "O preço subiu de R$ 12,90 para R$ 15,40 em um mês.", "A prefeitura adiou a obra da ponte por causa da chuva.",
)


def rows(n: int, seed: int = 5) -> list[tuple[str, set[tuple[int, str]]]]:
    """(text, {(start, kind)}) of two or three sentences each."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    make = {
        "name": lambda: " ".join([r.choice(GIVEN), *r.sample(LAST, r.choice([1, 2, 2])), *(["Filho"] if r.random() < 0.1 else [])]),
        "address": lambda: r.choice(STREETS), "cpf": lambda: f"{d(3)}.{d(3)}.{d(3)}-{d(2)}", "rg": lambda: f"{d(1)}.{d(3)}.{d(3)}", "pis": lambda: f"{d(3)}.{d(5)}.{d(2)}-{d(1)}",
        "phone": lambda: r.choice([f"({d(2)}) 9{d(4)}-{d(4)}", f"{d(2)} 3{d(3)}-{d(4)}", f"({d(2)}) 2{d(3)}-{d(4)}"]), "email": lambda: f"{r.choice(GIVEN).lower().replace('â', 'a')}.{r.choice(['vendas', 'rh', 'souza'])}{d(1)}@{r.choice(HOSTS)}",
    }
    out = []
    for _ in range(n):
        text, found = "", set()
        for _ in range(r.choice([2, 3])):
            frame = (" " if text else "") + r.choice(FRAMES)
            while "{" in frame:
                i, j = frame.index("{"), frame.index("}")
                kind = frame[i + 1 : j]
                text += frame[:i]
                found.add((len(text), kind))
                text, frame = text + make[kind](), frame[j + 1 :]
            text += frame
        out.append((text, found))
    return out
